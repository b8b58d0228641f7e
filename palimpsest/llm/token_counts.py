"""Token counts of whole texts by counting each distinct pre-token once.

A pre-token is a unit of bpe.units(): its ids don't depend on its neighbours, so a document has
the sum over its pre-tokens of frequency times pieces. Pre-tokens are counted over the corpus with
partial sums, each distinct one is encoded once for its number of pieces, and the numbers are
joined to every document's frequencies. The most frequent pre-tokens, at most ``HEAD``, are sent
to all tasks and joined while a document is read; the others are joined by a shuffle, a row for
each (pre-token, document). No ids leave the counting step.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bpe import RANKS, VOCABULARY, UnitCodec, units
from palimpsest.llm.common import materialize, table

#: The table that is sent to all tasks has at most so many pre-tokens of at most HEAD_CHARS characters.
HEAD, HEAD_CHARS = 1 << 17, 48
LIMIT = 512
#: Distinct pre-tokens that a task holds before it hands on what it has counted.
_HELD = 400_000


def pretoken_counts(texts: DataFrame) -> DataFrame:
    """(unit, n): how often each pre-token occurs in all texts."""

    def counted(batches):
        counts: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["unit", "n"])
            counts.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(units(text))
                if len(counts) > _HELD:
                    yield from out()
        yield from out()

    return texts.mapInArrow(counted, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def pieces(counts: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """Adds to each distinct pre-token its number of pieces."""

    def encoded(batches):
        codec = UnitCodec(vocabulary, ranks)
        for batch in batches:
            out = [len(codec.encode(x)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], ["unit", "n", "pieces"])

    return counts.mapInArrow(encoded, "unit string, n long, pieces long")


def _head(counted: DataFrame) -> dict[str, int]:
    """Pieces of the pre-tokens whose frequency has a rounded logarithm (to base 1.19) of at least
    the smallest one that keeps the table within HEAD rows."""
    level = F.floor(F.log2("n") * 4)
    short = counted.where((F.col("n") > 1) & (F.length("unit") <= HEAD_CHARS)).withColumn("level", level)
    sizes = {r["level"]: r["k"] for r in short.groupBy("level").agg(F.count(F.lit(1)).alias("k")).collect()}
    least, total = 1 << 20, 0
    for x in sorted(sizes, reverse=True):
        if (total := total + sizes[x]) > HEAD:
            break
        least = x
    rows = short.where(F.col("level") >= least).select("unit", "pieces").toPandas()
    return dict(zip(rows["unit"], rows["pieces"].tolist(), strict=True))


def count_tokens(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text).

    A null text counts as empty: no bytes, no tokens. Rows that repeat a doc_id are counted one
    by one. Special strings inside a text count as the library's default has them, as one special
    token. An empty table gives an empty result."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = materialize(pieces(pretoken_counts(rows.select("text")), vocabulary, ranks), "pieces")
    head = rows.sparkSession.sparkContext.broadcast(_head(counted))

    def split(batches):
        """A row for each document with the pieces of its frequent pre-tokens, and one for each
        other pre-token. The document's own row has a join key that no other row has, so that
        such rows don't meet in one task."""
        known = head.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            ids, rows, texts = (batch.column(i).to_pylist() for i in range(3))
            for doc_id, row, text in zip(ids, rows, texts, strict=True):
                sure, rest = 0, []
                for unit, n in Counter(units(text or "")).items():
                    if (k := known.get(unit)) is None:
                        rest.append((row, None, None, n, unit))
                    else:
                        sure += k * n
                for line in ((row, doc_id, len((text or "").encode()), sure, f"\0{row}"), *rest):
                    for a, b in zip(out, line, strict=True):
                        a.append(b)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(out, types, strict=True)], ["row", "doc_id", "n_bytes", "n", "unit"])

    numbered = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    parts = numbered.mapInArrow(split, "row long, doc_id long, n_bytes long, n long, unit string")
    joined = parts.join(counted.select(F.col("unit").alias("_unit"), "pieces"), F.col("unit") == F.col("_unit"), "left")
    tokens = F.when(F.col("n_bytes").isNotNull(), F.col("n")).otherwise(F.col("n") * F.col("pieces"))
    sums = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count_tokens() over all documents."""
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))
