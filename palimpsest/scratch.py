"""Intermediate tables in the folder that a cluster shares.

They go to the folder that ``spark.checkpoint.dir`` names; a folder of our own is used only by a
local session that names none. Each application has its own part of it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_RUNS: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one in local mode where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    return _OWN[context.applicationId]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that this application has materialized; results that read it must have been
    taken before. Runs by itself when the driver's Python ends before its session does."""
    _delete(spark, f"{scratch_dir(spark)}/palimpsest/{spark.sparkContext.applicationId}")


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None and spark.sparkContext.applicationId in _RUNS:
        clear_scratch(spark)


def materialize(frame: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Writes frame as Parquet to the shared folder and reads it back: cuts the lineage, and the
    rows outlive any executor. A materialized frame that it takes the place of is deleted."""
    spark = frame.sparkSession
    application = spark.sparkContext.applicationId
    if not _RUNS:
        atexit.register(_at_exit)
    _RUNS.add(application)
    path = f"{scratch_dir(spark)}/palimpsest/{application}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.scratch_path = path
    if instead_of is not None:
        _delete(spark, instead_of.scratch_path)
    return out
