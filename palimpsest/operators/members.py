"""Memberships, and appends with numbers of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.filters import ASKED, compile_session_filter


def where_sessions(sessions: DataFrame, members: DataFrame, request: str | None) -> DataFrame:
    """Sessions (name, ...) that a filter matches, with members (session, peer, active). Only
    active members that some test of the filter is about are read on; a session's answers are
    partial aggregates, so no list of members is made, however many a session has."""
    condition, asked = compile_session_filter(request)
    if not asked:
        return sessions.where(condition)
    tests = [F.coalesce(test(F.col("peer")), F.lit(False)) for test in asked]
    about = members.where(F.col("active") & reduce(Column.__or__, tests))
    names = [ASKED.format(i) for i in range(len(asked))]
    answers = about.groupBy(F.col("session").alias("_session")).agg(*[F.bool_or(t).alias(n) for t, n in zip(tests, names, strict=True)])
    both = sessions.join(answers, F.col("name") == F.col("_session"), "left")
    return both.withColumns({n: F.coalesce(n, F.lit(False)) for n in names}).where(condition).select(*sessions.columns)


def sessions_with(sessions: DataFrame, members: DataFrame, peer: str) -> DataFrame:
    """Sessions with the peer as an active member."""
    return sessions.join(members.where((F.col("peer") == peer) & F.col("active")).select(F.col("session").alias("name")), "name", "left_semi")


def sessions_without(sessions: DataFrame, members: DataFrame, peer: str) -> DataFrame:
    """Sessions that no active member of that name is in, those without members too."""
    return sessions.join(members.where((F.col("peer") == peer) & F.col("active")).select(F.col("session").alias("name")), "name", "left_anti")


def add_peers(members: DataFrame, asked: DataFrame, now: str) -> DataFrame:
    """Members (workspace, session, peer, observe_me, observe_others, joined_at, left_at) after
    asked ones (workspace, session, peer, observe_me, observe_others) were added: who is active
    keeps joined_at and configuration, who had left or is new joins now."""
    keys = ["workspace", "session", "peer"]
    when = F.to_timestamp_ntz(F.lit(now))
    new = asked.dropDuplicates(keys).select(*keys, F.col("observe_me").alias("_me"), F.col("observe_others").alias("_others"), F.lit(True).alias("_asked"))
    both = members.withColumn("_had", F.lit(True)).join(new, keys, "full_outer")
    joins = F.col("_asked").isNotNull() & (F.col("_had").isNull() | F.col("left_at").isNotNull())
    pick = lambda old, new: F.when(joins, F.coalesce(new, old)).otherwise(F.col(old))
    return both.select(*keys, pick("observe_me", "_me").alias("observe_me"), pick("observe_others", "_others").alias("observe_others"), F.when(joins, when).otherwise(F.col("joined_at")).alias("joined_at"), F.when(joins, F.lit(None)).otherwise(F.col("left_at")).alias("left_at"))


def remove_peers(members: DataFrame, gone: DataFrame, now: str) -> DataFrame:
    """Active members among ``gone`` (workspace, session, peer) leave now; others aren't touched."""
    keys = ["workspace", "session", "peer"]
    marks = gone.select(*keys).distinct().withColumn("_gone", F.lit(True))
    leaves = F.col("_gone").isNotNull() & F.col("left_at").isNull()
    return members.join(marks, keys, "left").withColumn("left_at", F.when(leaves, F.to_timestamp_ntz(F.lit(now))).otherwise(F.col("left_at"))).drop("_gone")


def set_peers(members: DataFrame, asked: DataFrame, now: str) -> DataFrame:
    """The asked peers are added; active members of the same sessions that aren't asked leave."""
    keys = ["workspace", "session", "peer"]
    active = members.where("left_at IS NULL").join(asked.select("workspace", "session").distinct(), ["workspace", "session"], "left_semi")
    return add_peers(remove_peers(members, active.join(asked, keys, "left_anti"), now), asked, now)


def number_messages(appended: DataFrame, last_seq: DataFrame) -> DataFrame:
    """Adds seq to appended messages (session, batch, position, ...): they go on from the session's
    last_seq (session, last_seq) without gaps, in the order of (batch, position)."""
    place = F.row_number().over(Window.partitionBy("session").orderBy("batch", "position"))
    return appended.join(last_seq, "session", "left").withColumn("seq", F.coalesce("last_seq", F.lit(0)) + place).drop("last_seq")


def unseen_requests(requests: DataFrame, records: DataFrame, now: str) -> DataFrame:
    """Requests (workspace, key_hash, position, ...) to carry out: the first of each key, unless a
    record (workspace, key_hash, expires_at) of it is still alive. An expired key is free again."""
    keys = ["workspace", "key_hash"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("position"))
    fresh = requests.withColumn("_r", first).where("_r = 1").drop("_r")
    alive = records.where(F.col("expires_at") > F.to_timestamp_ntz(F.lit(now))).select(*keys)
    return fresh.join(alive, keys, "left_anti")


def appended(members: DataFrame, said: DataFrame, now: str) -> DataFrame:
    """Members (see add_peers()) after messages (workspace, session, peer) were appended: senders
    join, and those that are active keep what they have."""
    asked = said.select("workspace", "session", "peer").distinct()
    none = F.lit(None).cast("boolean")
    return add_peers(members, asked.select("*", none.alias("observe_me"), none.alias("observe_others")), now)


def configuration(members: DataFrame, asked: DataFrame) -> DataFrame:
    """What active members among ``asked`` (workspace, session, peer) have set; others aren't there."""
    keys = ["workspace", "session", "peer"]
    return members.where("left_at IS NULL").join(asked.select(*keys).distinct(), keys, "left_semi").select(*keys, "observe_me", "observe_others")


def configure(members: DataFrame, asked: DataFrame) -> DataFrame:
    """Members after active ones among ``asked`` (workspace, session, peer, observe_me,
    observe_others) got what is asked for, where it isn't null."""
    keys = ["workspace", "session", "peer"]
    new = asked.dropDuplicates(keys).select(*keys, F.col("observe_me").alias("_me"), F.col("observe_others").alias("_others"))
    active = F.col("left_at").isNull()
    pick = lambda old, to: F.when(active, F.coalesce(to, old)).otherwise(F.col(old))
    both = members.join(new, keys, "left")
    return both.withColumn("observe_me", pick("observe_me", "_me")).withColumn("observe_others", pick("observe_others", "_others")).select(*members.columns)


_GRANT = ["principal", "workspace", "role"]


def _granted(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """A join of grants in which a null workspace is equal to itself."""
    have = b.select(*[F.col(k).alias(f"_{k}") for k in _GRANT])
    same = F.col("principal").eqNullSafe(F.col("_principal")) & F.col("workspace").eqNullSafe(F.col("_workspace")) & F.col("role").eqNullSafe(F.col("_role"))
    return a.select(*_GRANT).join(have, same, how)


def missing_grants(grants: DataFrame, asked: DataFrame) -> DataFrame:
    """Grants to add: asked ones that aren't there."""
    return _granted(asked.distinct(), grants, "left_anti")


def without_grants(grants: DataFrame, gone: DataFrame) -> DataFrame:
    """The grants but those in ``gone``, which need not be there."""
    return _granted(grants, gone, "left_anti")


def grants_of(grants: DataFrame, principal: str) -> DataFrame:
    """A principal's grants, each once, in order; the one for all workspaces comes first."""
    return grants.where(F.col("principal") == principal).select(*_GRANT).distinct().orderBy(F.asc_nulls_first("workspace"), "role")
