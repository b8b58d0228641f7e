"""Adapter views: the given tables in the shape of the memory model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of all time-dependent queries; never the wall clock.
NOW = "2024-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    return rows.select(F.concat_ws("-", "conv_id", F.col("turn") + 1).alias("id"), F.col("conv_id").cast("string").alias("session"), (F.col("turn") + 1).alias("seq"), F.col("role").alias("peer"), text.alias("content"), F.length(text).alias("token_count"))


MESSAGES = """messages AS (SELECT concat_ws('-', conv_id, turn + 1) AS id, CAST(conv_id AS VARCHAR) AS session, turn + 1 AS seq, role AS peer,
  coalesce(text, '') AS content, length(coalesce(text, '')) AS token_count FROM conversations)"""


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("session"), F.col("user_id").cast("string").alias("peer"), F.col("ts").alias("created_at"), F.round(F.col("value")).cast("int").alias("token_count"), F.col("props").alias("metadata"))


EVENT_MESSAGES = """event_messages AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS session, CAST(user_id AS VARCHAR) AS peer, ts AS created_at,
  CAST(round(value) AS INTEGER) AS token_count, props AS metadata, CAST(props->>'k' AS BIGINT) AS k FROM events)"""


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a member from the first sign-up until the last error."""
    rows = table(spark, sf_dir, "events")
    at = lambda kind, f: f(F.when(F.col("event_type") == kind, F.col("ts")))
    out = rows.groupBy(F.col("user_id").cast("string").alias("peer")).agg(at("signup", F.min).alias("joined_at"), at("error", F.max).alias("left_at"))
    return out.where("joined_at IS NOT NULL")


MEMBERSHIPS = """memberships AS (SELECT CAST(user_id AS VARCHAR) AS peer, min(ts) FILTER (event_type = 'signup') AS joined_at, max(ts) FILTER (event_type = 'error') AS left_at
  FROM events GROUP BY 1 HAVING joined_at IS NOT NULL)"""


def order_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), (F.col("o_orderstatus") == "O").alias("is_active"), F.col("o_orderdate").alias("created_at"))


def order_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("session"), F.col("l_suppkey").cast("string").alias("peer"), (F.col("l_returnflag") != "R").alias("active"))


ORDER_SESSIONS = "order_sessions AS (SELECT CAST(o_orderkey AS VARCHAR) AS name, o_orderstatus = 'O' AS is_active, o_orderdate AS created_at FROM orders)"
ORDER_MEMBERS = "order_members AS (SELECT CAST(l_orderkey AS VARCHAR) AS session, CAST(l_suppkey AS VARCHAR) AS peer, l_returnflag <> 'R' AS active FROM lineitem)"


def vector_conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("collection"), "embedding", F.floor(F.col("vec_id") / 10).alias("created_at"))


def text_conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("id"), F.col("source").alias("collection"), F.col("lang").alias("session"), F.coalesce("text", F.lit("")).alias("content"), F.pmod("doc_id", F.lit(3)).cast("int").alias("level"), (F.pmod(F.col("doc_id") * 7, F.lit(11)) + 1).cast("int").alias("times_derived"), F.col("n_chars").alias("created_at"))


TEXT_CONCLUSIONS = """text_conclusions AS (SELECT doc_id AS id, source AS collection, lang AS session, coalesce(text, '') AS content, CAST(doc_id % 3 AS INTEGER) AS level,
  CAST((doc_id * 7) % 11 + 1 AS INTEGER) AS times_derived, n_chars AS created_at FROM documents)"""


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item for each message; status, attempts and times follow from its numbers."""
    rows = messages(spark, sf_dir)
    mix = F.col("session").cast("bigint") * 31 + F.col("seq") * 7
    day = F.to_timestamp_ntz(F.lit("2024-05-31 23:00:00"))
    at = lambda minutes: F.timestamp_add("MINUTE", minutes.cast("int"), day)
    out = rows.select((F.col("session").cast("bigint") * 1000 + F.col("seq")).alias("id"), F.concat_ws(":", "session", "peer").alias("unit"), "session", "peer", "token_count", mix.alias("mix"))
    status = F.when(F.col("mix") % 9 == 0, 2).when(F.col("mix") % 17 == 0, 3).otherwise(0)
    return out.select("id", "unit", "session", "peer", "token_count", status.alias("status"), (F.col("mix") % 4).cast("int").alias("attempts"), at(F.col("mix") % 80).alias("available_at"), at(F.col("mix") % 55).alias("created_at"))


WORK_ITEMS = f"""{MESSAGES}, mixed AS (SELECT CAST(session AS BIGINT) * 1000 + seq AS id, session || ':' || peer AS unit, session, peer, token_count, CAST(session AS BIGINT) * 31 + seq * 7 AS mix FROM messages),
work_items AS (SELECT id, unit, session, peer, token_count, CASE WHEN mix % 9 = 0 THEN 2 WHEN mix % 17 = 0 THEN 3 ELSE 0 END AS status, CAST(mix % 4 AS INTEGER) AS attempts,
  TIMESTAMP '2024-05-31 23:00:00' + to_minutes(mix % 80) AS available_at, TIMESTAMP '2024-05-31 23:00:00' + to_minutes(mix % 55) AS created_at FROM mixed)"""


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth session's units are leased, to before or after NOW."""
    units = work_items(spark, sf_dir).select("unit", F.col("session").cast("bigint").alias("s")).distinct().where("s % 5 = 0")
    expires = F.timestamp_add("MINUTE", ((F.col("s") % 3) - 1).cast("int"), F.to_timestamp_ntz(F.lit(NOW)))
    return units.select("unit", F.lit("worker").alias("owner"), F.col("s").alias("token"), expires.alias("expires_at"))


LEASES = f"""leases AS (SELECT DISTINCT unit, 'worker' AS owner, CAST(session AS BIGINT) AS token, TIMESTAMP '{NOW}' + to_minutes(CAST(session AS BIGINT) % 3 - 1) AS expires_at
  FROM work_items WHERE CAST(session AS BIGINT) % 5 = 0)"""


def conclusion_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """conclusions (id, workspace, collection_id, session_id, level, content, embedding_state,
    created_at, deleted_at), collections, peers, sessions. Ids of names are hashes of them, every
    thirteenth conclusion is deleted, every third has its vector, and sources are observed by
    ``me``, which is internal."""
    rows = table(spark, sf_dir, "documents")
    key = lambda c: F.sha2(c, 256)
    names = rows.select(F.col("source").alias("name")).where("name IS NOT NULL").distinct()
    peers = names.unionByName(spark.createDataFrame([("me",)], "name string")).select(key(F.col("name")).alias("id"), "name", (F.col("name") == "me").alias("is_internal"))
    collections = names.select(key(F.concat(F.lit("me>"), "name")).alias("id"), key(F.lit("me")).alias("observer_id"), key(F.col("name")).alias("observed_id"))
    sessions = rows.select(F.col("lang").alias("name")).where("name IS NOT NULL").distinct().select(key(F.col("name")).alias("id"), "name")
    day = F.to_timestamp_ntz(F.lit("2024-05-31 00:00:00"))
    gone = F.when(F.col("doc_id") % 13 == 0, F.timestamp_add("HOUR", (F.col("doc_id") % 48 - 24).cast("int"), day))
    conclusions = rows.select(
        F.col("doc_id").alias("id"), F.lit("w").alias("workspace"), key(F.concat(F.lit("me>"), "source")).alias("collection_id"), key(F.col("lang")).alias("session_id"), F.pmod("doc_id", F.lit(3)).cast("tinyint").alias("level"),
        F.coalesce("text", F.lit("")).alias("content"), F.when(F.col("doc_id") % 3 == 1, 1).otherwise(0).alias("embedding_state"), F.timestamp_add("SECOND", (-F.col("doc_id") * 7 % 1000).cast("int"), day).alias("created_at"), gone.alias("deleted_at"),
    )
    return {"conclusions": conclusions, "collections": collections, "peers": peers, "sessions": sessions}


CONCLUSIONS = """conclusions AS (SELECT doc_id AS id, 'w' AS workspace, source, lang, CAST(doc_id % 3 AS TINYINT) AS level, coalesce(text, '') AS content, CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS embedding_state,
  TIMESTAMP '2024-05-31' + to_seconds(-doc_id * 7 % 1000) AS created_at, CASE WHEN doc_id % 13 = 0 THEN TIMESTAMP '2024-05-31' + to_hours(doc_id % 48 - 24) END AS deleted_at FROM documents)"""


def timed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages() with a time: a minute for each number, an hour for each session."""
    at = F.timestamp_add("MINUTE", (F.col("session").cast("bigint") % 500 * 60 + F.col("seq")).cast("int"), F.to_timestamp_ntz(F.lit("2024-05-01 00:00:00")))
    return messages(spark, sf_dir).withColumn("created_at", at)


TIMED_MESSAGES = f"""{MESSAGES}, timed AS (SELECT *, TIMESTAMP '2024-05-01' + to_minutes(CAST(session AS BIGINT) % 500 * 60 + seq) AS created_at FROM messages)"""
