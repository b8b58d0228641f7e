"""What the operators share: reading tables, cutting lineage, ranks, connected components.

Nothing here gathers rows on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.scratch import clear_scratch, materialize, scratch_dir

__all__ = ["clear_scratch", "components", "materialize", "parts_for", "salted_rank", "scratch_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*cols) if cols else frame


def parts_for(rows: int, each: int) -> int:
    """How many groups of about ``each`` rows hold ``rows`` rows."""
    return max(1, -(-int(rows) // each))


def salted_rank(frame: DataFrame, keys: list[str], order: list[str], rank: str, salts: int = 64) -> DataFrame:
    """Adds ``rank``, a 0-based number of each row within ``keys``, without bringing the rows of
    a key together: rows are numbered within (key, salt), and the salts of a key are laid one
    after the other by their counts. ``order`` also feeds the salt, so the numbering is a fixed
    function of the rows; it should tell rows apart, else ties are numbered arbitrarily."""
    salted = frame.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_salt").alias("_s"), "_base")
    same: Column = F.col("_salt") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    numbered = salted.withColumn("_in", F.row_number().over(within) - 1)
    numbered = numbered.join(counts, same, "left")
    return numbered.withColumn(rank, (F.col("_base") + F.col("_in")).cast("long")).drop("_salt", "_in", "_base", "_s", *[f"_k{i}" for i in range(len(keys))])


def _starred(edges: DataFrame) -> bool:
    """Whether every node above another hangs on one node only, which hangs on none."""
    up = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = up.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): returns (node, component), component
    being the smallest node that can be reached. Nodes without an edge don't appear.

    Alternating large-star and small-star steps. Every step is a partial minimum by node and an
    equi-join, so a hub's neighbours are never gathered in one row; each round's edges are
    written to the shared folder, until they are stars. Empty edges give an empty result; loops are
    ignored."""
    current = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    for _ in range(rounds):
        if _starred(current):
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))
        # a hub's edges: the salt makes the join's shuffle its own, so that a skewed part of it can be split
        above = both.where("b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(2)).cast("int"))
        each = low.withColumn("salt", F.explode(F.array(F.lit(0), F.lit(1)))).withColumnRenamed("node", "a")
        large = above.join(each, ["a", "salt"]).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = materialize(large, "large", current)
        low = large.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), "low")
        hung = large.join(low, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = hung.where("a > b").unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b"))).distinct()
        current = materialize(small, "small", large)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
