"""The work queue as tables: items and leases at a given time.

Items of one unit are worked on in the order of id by one owner at a time. Status: 0 pending,
1 failed (to be tried again), 2 succeeded, 3 dead-lettered; an item with 0 or 1 is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.keys import backoff_seconds

#: A unit is due with so many claimable tokens, or when its oldest claimable item is so old.
TOKENS, MAX_AGE_MINUTES = 512, 30
BATCH_TOKENS, BATCH_ITEMS, MAX_ATTEMPTS, ERROR_CHARS = 1024, 200, 5, 4000


def at(now: str) -> Column:
    return F.to_timestamp_ntz(F.lit(now))


def is_open() -> Column:
    return F.col("status").isin(0, 1)


def taken(leases: DataFrame, now: str) -> DataFrame:
    """Units whose lease hasn't run out; it holds up to and including expires_at."""
    return leases.where(F.col("expires_at") >= at(now)).select("unit")


def claimable(items: DataFrame, now: str) -> DataFrame:
    """Open items before the first one of their unit that is still backing off."""
    blocked = F.min(F.when(F.col("available_at") > at(now), F.col("id"))).over(Window.partitionBy("unit"))
    rows = items.where(is_open()).withColumn("_blocked", blocked)
    return rows.where("_blocked IS NULL OR id < _blocked").drop("_blocked")


def due_units(items: DataFrame, leases: DataFrame, now: str, tokens: int = TOKENS, age: int = MAX_AGE_MINUTES, policies: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """Units that may be acquired, with the first item, the tokens and the age of the claimable
    ones. ``policies``: tokens and minutes by task_type; items of other types are left out, and a
    unit goes by the type of its first item."""
    if policies is not None:
        table = items.sparkSession.createDataFrame([(k, *v) for k, v in policies.items()], "task_type int, _tokens long, _age int")
        mine = claimable(items.join(F.broadcast(table.select("task_type")), "task_type", "left_semi"), now).join(taken(leases, now), "unit", "left_anti")
        units = mine.groupBy("unit").agg(F.min("id").alias("first_id"), F.min_by("task_type", "id").alias("task_type"), F.count(F.lit(1)).alias("n_items"), F.sum("token_count").alias("tokens"), F.min("created_at").alias("oldest"))
        units = units.join(F.broadcast(table), "task_type")
        return units.where((F.col("tokens") >= F.col("_tokens")) | (F.timestamp_add("MINUTE", F.col("_age"), F.col("oldest")) <= at(now))).drop("_tokens", "_age")
    units = claimable(items, now).join(taken(leases, now), "unit", "left_anti").groupBy("unit").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_items"), F.sum("token_count").alias("tokens"), F.min("created_at").alias("oldest"))
    return units.where((F.col("tokens") >= tokens) | (F.timestamp_add("MINUTE", F.lit(age), F.col("oldest")) <= at(now)))


def token_batch(rows: DataFrame, target: int = BATCH_TOKENS, most: int = BATCH_ITEMS) -> DataFrame:
    """The items of each unit whose running sum of tokens fits the target, the first one always."""
    order = Window.partitionBy("unit").orderBy("id")
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    rows = rows.withColumn("running", F.sum("token_count").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("place") == 1) | (F.col("running") <= target))


def acquire(items: DataFrame, leases: DataFrame, now: str, owner: str, minutes: int = 5, units: int = 32) -> tuple[DataFrame, DataFrame]:
    """The leases and the items (attempts one up) of the oldest due units. Tokens of new leases are
    above all that were ever given."""
    due = due_units(items, leases, now).orderBy("first_id").limit(units)
    last = leases.agg(F.coalesce(F.max("token"), F.lit(0)).alias("last"))
    place = F.row_number().over(Window.orderBy("first_id"))
    given = due.crossJoin(F.broadcast(last)).select("unit", F.lit(owner).alias("owner"), (F.col("last") + place).alias("token"), F.timestamp_add("MINUTE", F.lit(minutes), at(now)).alias("expires_at"))
    batch = token_batch(claimable(items, now).join(F.broadcast(due.select("unit")), "unit", "left_semi"))
    return given, batch.withColumn("attempts", F.col("attempts") + 1)


def fenced(items: DataFrame, leases: DataFrame) -> DataFrame:
    """Items (unit, token, ...) whose token is still that of the unit's lease."""
    return items.join(leases.select("unit", "token"), ["unit", "token"], "left_semi")


def completed(items: DataFrame, now: str) -> DataFrame:
    return items.withColumn("status", F.lit(2)).withColumn("completed_at", at(now))


def failed(items: DataFrame, now: str, error: str, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Dead-lettered after ``most`` attempts, else to be tried again after a backoff."""
    dead = F.col("attempts") >= most
    later = F.timestamp_add("SECOND", backoff_seconds(F.col("attempts")).cast("int"), at(now))
    return items.withColumn("status", F.when(dead, 3).otherwise(1)).withColumn("available_at", F.when(dead, F.col("available_at")).otherwise(later)).withColumn("error", F.lit(error[:ERROR_CHARS]))


def released(items: DataFrame, now: str, seconds: int = 0) -> DataFrame:
    """Given back: the attempt doesn't count."""
    return items.withColumn("attempts", F.greatest(F.col("attempts") - 1, F.lit(0))).withColumn("available_at", F.timestamp_add("SECOND", F.lit(seconds), at(now)))


def renewed(leases: DataFrame, owner: str, now: str, minutes: int = 5) -> DataFrame:
    mine = (F.col("owner") == owner) & (F.col("expires_at") >= at(now))
    return leases.withColumn("expires_at", F.when(mine, F.timestamp_add("MINUTE", F.lit(minutes), at(now))).otherwise(F.col("expires_at")))


def status(items: DataFrame, leases: DataFrame, now: str, session: str | None = None, sender: str | None = None, observer: str | None = None, workspace: str | None = None) -> DataFrame:
    """Counts by session, and a row with a null session for all items. Of all items those are
    counted that are of the given workspace, session and sender (column peer) and that the given
    observer is among the ``observers`` of."""
    rows = items
    for name, value in (("session", session), ("peer", sender), ("workspace", workspace)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    rows = rows if observer is None else rows.where(F.array_contains("observers", observer))
    rows = rows.join(taken(leases, now).withColumn("_taken", F.lit(True)), "unit", "left")
    busy = is_open() & F.col("_taken").isNotNull()
    counts = [F.count_if(F.col("status") == 2).alias("completed"), F.count_if(F.col("status") == 3).alias("dead_lettered"), F.count_if(busy).alias("in_progress"), F.count_if(is_open() & F.col("_taken").isNull()).alias("pending")]
    out = rows.rollup("session").agg(*counts, F.grouping("session").alias("_all"))
    return out.where("_all = 1 OR session IS NOT NULL").drop("_all")


def wire_status(rows: DataFrame) -> DataFrame:
    """As clients see it: dead-lettered items count as completed."""
    return rows.select("session", (F.col("completed") + F.col("dead_lettered")).alias("completed"), "in_progress", "pending", (F.col("completed") + F.col("dead_lettered") + F.col("in_progress") + F.col("pending")).alias("total"))


def backlog(items: DataFrame, leases: DataFrame, now: str) -> DataFrame:
    """One row: how many units are due, and the creation time of the oldest open item."""
    due = due_units(items, leases, now).agg(F.count(F.lit(1)).alias("due_units"))
    oldest = items.where(is_open()).agg(F.min("created_at").alias("oldest_open"))
    return due.crossJoin(F.broadcast(oldest))


def pruned(items: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Without items that succeeded ``days`` ago or before."""
    old = (F.col("status") == 2) & (F.timestamp_add("DAY", F.lit(days), F.col("completed_at")) <= at(now))
    return items.where(~F.coalesce(old, F.lit(False)))


def named_items(items: DataFrame, workspaces: DataFrame, sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Items (workspace_id, session_id, message_id, ...) with the names that they refer to, null
    where that is gone: workspaces and sessions (id, name), messages (id, public_id)."""
    named = items
    for key, frame, column, name in (("workspace_id", workspaces, "name", "workspace"), ("session_id", sessions, "name", "session"), ("message_id", messages, "public_id", "message")):
        named = named.join(frame.select(F.col("id").alias(key), F.col(column).alias(name)), key, "left")
    return named
