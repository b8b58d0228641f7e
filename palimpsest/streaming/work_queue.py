"""The work queue as a stream of batches.

Items are keyed by unit, so one task owns a unit and no lease is needed. A unit's open items are
its state; a batch leaves as soon as they have enough tokens, or when the oldest has waited long
enough by the clock of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.work_queue import BATCH_ITEMS, BATCH_TOKENS, MAX_AGE_MINUTES, TOKENS

_OUT = "unit string, batch long, ids array<long>, tokens long, reason string"
_STATE = "batch long, ids array<long>, tokens array<long>, since long"


def cut(tokens: list[int], target: int = BATCH_TOKENS, most: int = BATCH_ITEMS) -> int:
    """How many items make the next batch: while their tokens fit, at least one."""
    total, n = 0, 0
    while n < min(len(tokens), most) and (n == 0 or total + tokens[n] <= target):
        total, n = total + tokens[n], n + 1
    return n


def batches(items: DataFrame, tokens: int = TOKENS, minutes: float = MAX_AGE_MINUTES) -> DataFrame:
    """Batches of a stream of items (unit, id, token_count): (unit, batch, ids, tokens, reason).
    Items are taken by id as they arrive in a micro-batch; reason is ``tokens``, or ``age`` where
    the unit's oldest item has waited for ``minutes`` since it arrived, whatever came after it. A
    unit keeps less than ``tokens`` tokens in its state, so states stay small."""
    wait = int(minutes * 60_000)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        number, ids, sizes, since = state.get if state.exists else (0, [], [], now)
        ids, sizes = list(ids), list(sizes)
        late = state.hasTimedOut or bool(ids and now >= since + wait)
        if not state.hasTimedOut:
            new = pd.concat(list(pdfs)).sort_values("id")
            since = since if ids else now
            ids, sizes = ids + new["id"].tolist(), sizes + new["token_count"].tolist()
        out = []
        while ids and (late or sum(sizes) >= tokens):
            reason = "tokens" if sum(sizes) >= tokens else "age"
            n = cut(sizes)
            number, since = number + 1, now
            out.append((key[0], number, ids[:n], sum(sizes[:n]), reason))
            ids, sizes = ids[n:], sizes[n:]
        state.update((number, ids, sizes, since))
        if ids:
            state.setTimeoutDuration(max(1, since + wait - now))
        if out:
            yield pd.DataFrame(out, columns=["unit", "batch", "ids", "tokens", "reason"])

    rows = items.select("unit", "id", "token_count")
    return rows.groupBy("unit").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def start_available(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Starts a query of batches() that takes what is there and ends. Micro-batches without data
    are left out, as one that may time out would ask for another one for ever; so ``age`` batches
    need a query with a processing-time trigger."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
