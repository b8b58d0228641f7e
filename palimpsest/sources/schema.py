"""Schemas of the memory model. Nothing is inferred; JSON stays text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_JSON = "metadata string, configuration string"
#: DDL of each relation. States: 0 active, 1 inactive, 2 deleting. Levels: see LEVELS.
DDL: dict[str, str] = {
    "workspaces": f"name string, state tinyint, {_JSON}, created_at timestamp_ntz",
    "peers": f"workspace string, name string, is_internal boolean, {_JSON}, created_at timestamp_ntz",
    "sessions": f"workspace string, name string, state tinyint, next_seq bigint, {_JSON}, created_at timestamp_ntz",
    "session_peers": "workspace string, session string, peer string, observe_me boolean, observe_others boolean, joined_at timestamp_ntz, left_at timestamp_ntz",
    "messages": "workspace string, session string, seq bigint, id string, peer string, content string, token_count int, metadata string, created_at timestamp_ntz",
    "collections": "workspace string, observer string, observed string, new_explicit_count bigint, last_activity_at timestamp_ntz, last_dream_at timestamp_ntz",
    "conclusions": "workspace string, id string, observer string, observed string, session string, level tinyint, content string, content_hash string, embedding array<float>, embedding_state tinyint, embedding_model string, times_derived int, source_ids array<string>, created_at timestamp_ntz, deleted_at timestamp_ntz",
    "peer_cards": "workspace string, observer string, observed string, entries array<string>, updated_at timestamp_ntz, updated_by string",
    "work_items": "id bigint, workspace string, session string, peer string, task_type tinyint, unit string, payload string, status tinyint, attempts int, available_at timestamp_ntz, token_count int, error string, created_at timestamp_ntz, completed_at timestamp_ntz",
    "leases": "unit string, owner string, token bigint, expires_at timestamp_ntz",
    "idempotency": "workspace string, key_hash string, request_hash string, status int, body string, expires_at timestamp_ntz",
    "grants": "principal string, workspace string, role string",
}

def schema(relation: str) -> StructType:
    return StructType.fromDDL(DDL[relation])


def empty(spark: SparkSession, relation: str) -> DataFrame:
    return spark.createDataFrame([], schema(relation))


def read(spark: SparkSession, root: str, relation: str, workspace: str | None = None) -> DataFrame:
    """A relation kept as Parquet under ``root``. Tables are partitioned by workspace, so a scan of
    one workspace reads its files alone."""
    frame = spark.read.schema(schema(relation)).parquet(f"{root}/{relation}")
    return frame if workspace is None else frame.where(F.col("workspace") == workspace)


def write(frame: DataFrame, root: str, relation: str, mode: str = "append") -> None:
    names = schema(relation).fieldNames()
    writer = frame.select(*names).write.mode(mode)
    (writer.partitionBy("workspace") if "workspace" in names else writer).parquet(f"{root}/{relation}")
