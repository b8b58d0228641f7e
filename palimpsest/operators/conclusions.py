"""Conclusions as rows of related tables: listing, lookup, insertion, deletion, embedding backlog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from palimpsest.functions.text import content_hash

#: States of an embedding.
PENDING, DONE, FAILED = 0, 1, 2
#: A list of names is sent to all tasks as long as it has at most so many.
MOST_SENT = 10_000
_NEW = ["workspace", "observer", "observed", "session", "level", "content"]


def at(now: str) -> Column:
    return F.to_timestamp_ntz(F.lit(now))


def live(rows: DataFrame, searchable: bool = False) -> DataFrame:
    """Rows that aren't deleted; searchable ones have their vector too."""
    out = rows.where(F.col("deleted_at").isNull())
    return out.where(F.col("embedding_state") == DONE) if searchable else out


def listing(rows: DataFrame, collections: DataFrame, peers: DataFrame, sessions: DataFrame) -> DataFrame:
    """Live conclusions (id, collection_id, session_id, ...) with the names of the observer, the
    observed and, where they have one, the session. collections (id, observer_id, observed_id),
    peers and sessions (id, name). Conclusions whose collection or peers are gone aren't listed."""
    name = lambda frame, key, out: frame.select(F.col("id").alias(key), F.col("name").alias(out))
    named = live(rows).join(collections.select(F.col("id").alias("collection_id"), "observer_id", "observed_id"), "collection_id")
    named = named.join(name(peers, "observer_id", "observer"), "observer_id").join(name(peers, "observed_id", "observed"), "observed_id")
    return named.join(name(sessions, "session_id", "session"), "session_id", "left")


def found(rows: DataFrame, column: str, value: str) -> DataFrame:
    """The row of that very name or public id: letter for letter, spaces at the end too."""
    return rows.where(F.col(column) == F.lit(value)).limit(1)


def among(spark: SparkSession, rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """The rows whose column is one of a list."""
    frame = spark.createDataFrame([(v,) for v in dict.fromkeys(values)], StructType([StructField(column, StringType())]))
    return rows.join(F.broadcast(frame) if len(values) <= MOST_SENT else frame, column, "left_semi")


def inserted(rows: DataFrame, new: DataFrame, now: str, ids: Column) -> DataFrame:
    """Conclusions with new ones (workspace, observer, observed, session, level, content,
    source_ids) added: not compared with those that are there, derived once, waiting for a vector.
    Raises ValueError, and adds none, where one has no content or no collection."""
    wrong = new.where(~F.coalesce(F.col("content").rlike(r"(?U)\S"), F.lit(False)) | F.col("observer").isNull() | F.col("observed").isNull() | F.col("workspace").isNull())
    if not wrong.isEmpty():
        raise ValueError("a conclusion without content, workspace, observer or observed")
    fixed = {"id": ids, "content_hash": content_hash(F.col("content")), "embedding": F.lit(None).cast("array<float>"), "embedding_state": F.lit(PENDING), "times_derived": F.lit(1), "created_at": at(now), "deleted_at": F.lit(None).cast("timestamp_ntz"), "embedding_model": F.lit(None).cast("string")}
    made = new.select(*_NEW, "source_ids").withColumns(fixed)
    return rows.unionByName(made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema]))


def tombstoned(rows: DataFrame, gone: DataFrame, now: str) -> DataFrame:
    """Rows after those in ``gone`` (workspace, id) were deleted: hidden, not removed. Rows that are
    deleted already keep their time."""
    marks = gone.select("workspace", "id").distinct().withColumn("_gone", F.lit(True))
    hit = F.col("_gone").isNotNull() & F.col("deleted_at").isNull()
    return rows.join(marks, ["workspace", "id"], "left").withColumn("deleted_at", F.when(hit, at(now)).otherwise(F.col("deleted_at"))).select(*rows.columns)


def purged(rows: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Without rows that were deleted ``hours`` ago or before. Others may still name them as their
    sources; reads leave such names out."""
    return rows.where(F.col("deleted_at").isNull() | (F.timestamp_add("HOUR", F.lit(hours), F.col("deleted_at")) > at(now)))


def unexpired(records: DataFrame, now: str) -> DataFrame:
    """Records of requests without those that have run out."""
    return records.where(F.col("expires_at") > at(now))


def pending(rows: DataFrame, workspaces: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Live conclusions that wait for a vector; of workspaces that are there, if given (name); the
    oldest ``limit`` of them, in order."""
    out = live(rows).where(F.col("embedding_state") == PENDING)
    if workspaces is not None:
        out = out.join(workspaces.select(F.col("name").alias("workspace")), "workspace", "left_semi")
    return out if limit is None else out.orderBy("created_at", "id").limit(limit)


def count_pending(rows: DataFrame) -> DataFrame:
    return pending(rows).agg(F.count(F.lit(1)).alias("pending"))


def save_embeddings(rows: DataFrame, made: DataFrame) -> DataFrame:
    """Rows after vectors (id, content, vector, and model where there is such a column) were taken
    over, or null ones marked as failed: only by live conclusions that still wait for one and still
    have that content."""
    model = F.col("model") if "model" in made.columns else F.lit(None).cast("string")
    new = made.select("id", F.col("content").alias("_content"), F.col("vector").alias("_vector"), model.alias("_model"))
    both = rows.join(new, "id", "left")
    fits = F.coalesce((F.col("embedding_state") == PENDING) & (F.col("content") == F.col("_content")) & F.col("deleted_at").isNull(), F.lit(False))
    saved = fits & F.col("_vector").isNotNull()
    state = F.when(saved, DONE).when(fits, FAILED).otherwise(F.col("embedding_state")).cast(rows.schema["embedding_state"].dataType)
    new = {"embedding": F.when(saved, F.col("_vector")).otherwise(F.col("embedding")), "embedding_state": state}
    if "embedding_model" in rows.columns:
        new["embedding_model"] = F.when(saved, F.col("_model")).otherwise(F.col("embedding_model"))
    return both.withColumns(new).select(*rows.columns)


def peers_of_kind(peers: DataFrame, kind: str = "regular") -> DataFrame:
    """Peers that are ``regular``, that are a ``scope`` (internal ones), or ``all``."""
    if kind not in ("regular", "scope", "all"):
        raise ValueError(f"no kind of peers: {kind}")
    return peers if kind == "all" else peers.where(F.col("is_internal") == (kind == "scope"))
