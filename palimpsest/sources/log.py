"""Append-only logs with atomic batches.

A batch writes all of its tables under its own folder and is published by one rename of a marker
file; readers see published batches only. A batch id that was published already is not written
again, so a retry changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return bool(fs.exists(where))


def publish(spark: SparkSession, root: str, batch_id: str, tables: dict[str, DataFrame]) -> bool:
    """Writes the tables of one batch and publishes them together; False if it was there before."""
    marker = f"{root}/published/{batch_id}"
    if _exists(spark, marker):
        return False
    attempt = f"{batch_id}-{uuid.uuid4().hex}"
    for name, frame in tables.items():
        frame.write.parquet(f"{root}/data/{attempt}/{name}")
    fs, draft = _fs(spark, f"{root}/drafts/{attempt}")
    fs.mkdirs(draft.getParent())
    out = fs.create(draft, False)
    out.writeBytes(attempt)
    out.close()
    _, final = _fs(spark, marker)
    fs.mkdirs(final.getParent())
    return bool(fs.rename(draft, final))


def read_log(spark: SparkSession, root: str, table: str, ddl: str) -> DataFrame:
    """All published rows of a table, with their batch_id; no rows before the first batch."""
    folder = f"{root}/published"
    if not _exists(spark, folder):
        return spark.createDataFrame([], f"{ddl}, batch_id string")
    marks = spark.read.text(folder, wholetext=True).select(F.col("value").alias("attempt"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("batch_id"))
    attempts = [(r["attempt"], r["batch_id"]) for r in marks.collect()]
    paths = [(f"{root}/data/{a}/{table}", b) for a, b in attempts if _exists(spark, f"{root}/data/{a}/{table}")]
    if not paths:
        return spark.createDataFrame([], f"{ddl}, batch_id string")
    frame = spark.read.schema(ddl).parquet(*[p for p, _ in paths])
    attempt = F.element_at(F.split(F.input_file_name(), "/"), -3)
    return frame.withColumn("batch_id", F.regexp_replace(attempt, "-[0-9a-f]{32}$", ""))


def latest(log: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The last row of each key by version."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(v) for v in version])
    return log.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def latest_values(log: DataFrame, keys: list[str], version: str, values: list[str]) -> DataFrame:
    """For each key the last value of each column that isn't null: an update of null leaves it."""
    return log.groupBy(*keys).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(version))).alias(v) for v in values])


def create_missing(existing: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Get-or-create: the existing rows, and the first asked row of each key that has none. The
    asked rows need a column ``position``, which isn't returned."""
    first = Window.partitionBy(*keys).orderBy("position")
    new = asked.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "position")
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"))
