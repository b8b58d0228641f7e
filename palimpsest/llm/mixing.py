"""Mixing sources to target weights, by subset-sum budget fitting.

Each source's target is met by whole passes over its documents and a rest. For the rest, the
documents are counted by exact length. A bounded knapsack over the counts (reachable sums as a
field of booleans, a count split into powers of two) finds the documents of each length whose
lengths sum to the rest, or to the nearest sum. The field reaches as far as ``FIT_BUDGET`` words
and ``FIT_LENGTHS`` times the longest document, after division by the lengths' common divisor. Of
a larger rest, most is filled first, the same share of every length, but as many documents of each
length as the field has room for are held back where they can be, so that the knapsack still
chooses among all lengths; a rest above half of the source is fitted by what is left out. The
outcome is a number of documents for each (source, length); the documents are the first that many
by a seeded hash. Only (source, length) counts are gathered, one source to a task.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, salted_rank, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
FIT_BUDGET, FIT_LENGTHS = 1 << 18, 16
SEED = 20
_SELECTION = "source string, size long, passes long, picked long"


def document_sizes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, digest) and columns ``keep``: words between ASCII white space, and a
    hash of the text; a null text has no words."""

    def counted(batches):
        for batch in batches:
            sizes = [len(x.split()) if x else 0 for x in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *batch.columns[3:]], ["doc_id", "source", "size", "digest", *keep])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("digest"), *keep)
    types = "".join(f", {x} {rows.schema[x].dataType.simpleString()}" for x in keep)
    return rows.mapInArrow(counted, "doc_id long, source string, size long, digest long" + types)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, target): weights repeat over sources by code point, null last. A
    target stops at ``most`` times its source's size and the excess is reshared by weight: the
    level L solves sum(min(L * weight, cap)) = share * all words, found by laying the sources out
    by cap / weight. One row for each source; a source without words gets 0."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    every = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - F.col("capped")) / F.col("open"))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.coalesce(F.min_by("level", F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.coalesce("source", F.lit("\U0010ffff"))))).over(every), F.lit(float("inf")))
    return rows.withColumn("level", level).select("source", "source_size", F.least(F.col("level") * F.col("weight"), F.col("cap")).alias("target"))


def fit_budget(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their lengths sum to ``budget``, or to
    the nearest sum (the smaller one of two). counts: documents by length."""
    sizes = sorted((s for s in counts if s > 0), reverse=True)
    total = sum(s * counts[s] for s in sizes)
    if not total or budget <= 0:
        return dict.fromkeys(sizes, 0)
    if budget >= total:
        return {s: counts[s] for s in sizes}
    if 2 * budget > total:
        return {s: counts[s] - n for s, n in fit_budget(counts, total - budget).items()}
    unit = gcd(*sizes)
    room = max(FIT_BUDGET, FIT_LENGTHS * sizes[0] // unit) * unit
    taken = dict.fromkeys(sizes, 0)
    if budget > room:
        fill = budget - room // 2
        held = {s: min(counts[s], room // s) for s in sizes}
        free = sum(s * (counts[s] - held[s]) for s in sizes)
        for s in sizes:  # of what isn't held back where that is enough, else of all
            taken[s] = (counts[s] - held[s]) * fill // free if free >= fill else counts[s] * fill // total
    left = budget - sum(s * n for s, n in taken.items())
    for s in sizes:  # what rounding left beyond the field
        n = max(0, min(counts[s] - taken[s], (left - room // 2) // s)) if left > room else 0
        taken[s] += n
        left -= s * n
    knapsack = _nearest({s // unit: counts[s] - taken[s] for s in sizes}, left / unit)
    return {s: taken[s] + knapsack.get(s // unit, 0) for s in sizes}


def _nearest(counts: dict[int, int], budget: float) -> dict[int, int]:
    """The bounded knapsack: documents of each length for the sum nearest to ``budget``. Each
    reachable sum keeps the item that reached it first."""
    sizes = sorted(counts, reverse=True)
    most = int(budget + min(sizes[0], budget)) + 1
    items: list[tuple[int, int]] = []
    for s in sizes:
        rest, n = min(counts[s], most // s), 1
        while rest > 0:
            items.append((s, n := min(n, rest)))
            rest, n = rest - n, 2 * n
    first = np.full(most + 1, -1, dtype=np.int32)
    reach = np.zeros(most + 1, dtype=bool)
    reach[0] = True
    for k, (s, n) in enumerate(items):
        if s * n <= most:
            new = ~reach[s * n :] & reach[: most + 1 - s * n]
            first[s * n :][new] = k
            reach[s * n :] |= new
        if reach[int(budget)] and budget == int(budget):
            break
    sums = np.flatnonzero(reach)
    at, out = int(sums[np.argmin(np.abs(sums - budget))]), dict.fromkeys(sizes, 0)
    while at:
        s, n = items[first[at]]
        out[s] += n
        at -= s * n
    return out


def _select(pdf: pd.DataFrame) -> pd.DataFrame:
    counts = dict(zip(pdf["size"], pdf["n"], strict=True))
    whole, target = int(pdf["source_size"].iloc[0]), pdf["target"].iloc[0]
    passes = min(int(target // whole), MOST_PASSES) if whole else 1
    rest = int(round(target - passes * whole)) if whole and passes < MOST_PASSES else 0
    taken = fit_budget(counts, rest)
    out = pdf[["source", "size"]].copy()
    out["passes"], out["picked"] = passes, [taken.get(s, 0) for s in pdf["size"]]
    return out


def mix(docs: DataFrame, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) and columns ``keep`` for all rows
    of docs (doc_id, source, text): ``times`` is how often the mix takes the row, at most
    MOST_PASSES, and taken is times * size. Rows with the same doc_id are documents of their own,
    a null source is a source. Documents without words cost nothing and are taken as often as
    their source's whole passes. Reruns agree: documents of a length are in the order of a hash of
    doc_id, then of doc_id and text; an empty table gives an empty result."""
    sizes = materialize(document_sizes(docs, keep), "sizes")
    targets = materialize(source_targets(sizes), "targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    counts = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(targets, same(counts, targets)).select(counts["source"], "size", "n", "source_size", "target")
    picks = materialize(counts.groupBy("source").applyInPandas(_select, _SELECTION), "picks")
    ranked = salted_rank(sizes.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id")), ["source", "size"], ["_order", "doc_id", "digest"], "rank")
    joined = ranked.join(picks, same(ranked, picks) & (ranked["size"] == picks["size"]), "left").select(ranked["doc_id"], ranked["source"], ranked["size"], "rank", "passes", "picked", *keep)
    joined = joined.join(targets, same(joined, targets), "left").select("doc_id", joined["source"], "size", "source_size", "target", "rank", "passes", "picked", *keep)
    times = F.col("passes") + (F.col("rank") < F.col("picked")).cast("long")
    return joined.withColumn("times", times).select("doc_id", "source", "size", "source_size", "target", "times", (times * F.col("size")).alias("taken"), *keep)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() over all documents."""
    out = mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
