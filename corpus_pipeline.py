"""A training corpus from documents, in five stages. Each stage works on all rows that the one
before has kept, written as Parquet and read again."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from palimpsest.llm.common import materialize
from palimpsest.llm.dedup_exact import dedup_documents
from palimpsest.llm.language_id import UNDETERMINED, held_out, learn_profiles, predict_language
from palimpsest.llm.mixing import mix
from palimpsest.llm.ngram_join import jaccard_components
from palimpsest.llm.packing import pack_documents

#: A text whose n-grams are further than this from every language is no language.
LEAST_SCORE = 0.2


def bundled(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): other columns go into a struct, so that their names can't clash."""
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest or [F.lit(None).alias("none")]).alias("rest"))


def laid_out(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in columns])


def numbered(docs: DataFrame) -> DataFrame:
    """bundled() with a number ``_row`` for each row, as doc_id may be null or repeat."""
    return materialize(bundled(docs).withColumn("_row", F.monotonically_increasing_id()), "numbered")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null and empty ones too) and those like no language."""
    profiles = learn_profiles(docs.where(~held_out("doc_id")))
    said = predict_language(bundled(docs), profiles, ["doc_id", "text", "rest"])
    return laid_out(said.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)), docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of those with equal texts (A-Z lower-cased; null counts as empty), that with
    the largest doc_id. Of rows that repeat doc_id and text one stays, and all rows whose doc_id is
    null where no equal text has one, but one for each text. An empty table stays empty."""

    def keyed(batches):
        for batch in batches:
            out = [hashlib.sha256((x.as_py() or b"").lower()).digest() for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["doc_id", "text", "rest", "_digest"])

    answers = materialize(dedup_documents(docs), "answers")
    lost = answers.where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_d"))
    rows = bundled(docs)
    rows = rows.mapInArrow(keyed, StructType([*rows.schema.fields, StructField("_digest", BinaryType())]))
    rows = rows.join(lost, rows["doc_id"].eqNullSafe(lost["_id"]) & (rows["_digest"] == lost["_d"]), "left_anti")
    again = answers.where("kept AND copies > 1").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_d"))
    if not again.isEmpty():
        same = rows["doc_id"].eqNullSafe(again["_id"]) & (rows["_digest"] == again["_d"])
        rows = rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(["doc_id", "_digest"]))
    return laid_out(rows, docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that with the smallest doc_id, null ones
    last, then by a hash of the text. Texts without words, null ones too, are kept, and so is all
    of an empty table, which is nothing."""
    rows = numbered(docs)
    found = jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "_row")
    members = materialize(found.join(rows.select("_row", order.alias("_order")), "_row"), "members")
    groups = members.groupBy("_group").agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_group", F.col("_first._row").alias("_stays"))
    lost = members.join(groups, "_group").where("_row <> _stays").select("_row")
    return laid_out(rows.join(lost, "_row", "left_anti"), docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice. Rows with one doc_id, or
    without one, are documents of their own; null texts have no words and follow their source's
    whole passes. An empty table stays empty."""
    rows = numbered(docs)
    times = mix(rows.select("doc_id", "rest.source", "text", "_row"), keep=("_row",)).where("times > 0").select("_row", "times")
    taken = rows.join(times, "_row").withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return laid_out(taken, docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; a document taken twice is packed twice. A
    null text is packed as its end id alone, a null doc_id is told as it is, no rows give no pieces."""
    return pack_documents(docs).drop("copy")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("packing", packing)]

#: Profiles, links and packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
