"""Near duplicates among embeddings, by an inverted multi-index.

Unit vectors are cut into halves; each half has a codebook of its own, and pairs of code words
form the grid of cells. A vector lies in the cell of its nearest code words and visits cells in
the multi-sequence order, by the sum of its halves' squared distances to them, as many as it takes
to reach the target recall. That number is found by trial: sampled vectors are turned to exactly
the threshold's angle in random directions, and the visits needed to meet the turned vectors' cells
are counted. Vectors that meet in a cell are verified in double precision.

Equal vectors form a class and are compared once; vectors of each length have an index of their
own. The cells of one first code word, or of a part of the second ones beside it, are a group, so
that a vector is sent to a group once however many of its cells it visits. Groups with many vectors
are dealt out in blocks, and a block hands on counts and a spanning forest of its links, not the
links. The codebooks are fitted on at most ``SAMPLE`` vectors; every vector is indexed and asks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from palimpsest.llm.common import components, materialize, table

THRESHOLD = 0.95
TARGET_RECALL = 0.995
#: Vectors of a length that codebooks are fitted on: LEAST_SAMPLE, with many code words more, SAMPLE at most.
LEAST_SAMPLE, SAMPLE, TRIALS = 8_192, 32_768, 1_024
#: Vectors to a cell, about, as long as a half has at most MOST_WORDS code words.
PER_CELL, MOST_WORDS = 96, 8_192
#: Held vectors of a group, about, and vectors that ask in one call.
BLOCK, ASKING = 2_048, 16_384
#: Numbers that one step of an index computes at once, about.
_AT_ONCE = 1 << 21


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; they are first scaled by powers of two, so that no square overflows."""
    rows = rows.astype(np.float64)
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _rows(column, dtype: str) -> np.ndarray:
    """Vectors of one length from their bytes."""
    parts = [bytes(x) for x in column]
    return np.frombuffer(b"".join(parts), dtype=dtype).reshape(len(parts), -1)


def packed(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, vec) and the type of the numbers: vec has a vector's bytes, and is null for vectors
    that can't link: null, empty, zero, or with a null or non-finite component."""
    double = vectors.schema["embedding"].dataType == ArrayType(DoubleType(), vectors.schema["embedding"].dataType.containsNull)
    dtype, kind = ("<f8", "double") if double else ("<f4", "float")

    def listed(batches):
        for batch in batches:
            vec = []
            for x in batch.column(1).to_pylist():
                row = np.array([np.nan if y is None else y for y in x or []], dtype=dtype)
                vec.append(row.tobytes() if len(row) and np.isfinite(row).all() and (row != 0).any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vec, pa.binary())], ["vec_id", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    return rows.mapInArrow(listed, "vec_id long, vec binary"), dtype


def squared(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (rows**2).sum(axis=1)[:, None] - 2 * rows @ centers.T + (centers**2).sum(axis=1)


def _chunks(rows: np.ndarray, width: int):
    step = max(1, _AT_ONCE // max(1, width))
    return (rows[i : i + step] for i in range(0, len(rows), step))


def codebook(rows: np.ndarray, words: int, rounds: int = 12) -> np.ndarray:
    """Code words by k-means from evenly spread starting rows."""
    centers = rows[np.linspace(0, len(rows) - 1, words).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([squared(x, centers).argmin(axis=1) for x in _chunks(rows, words)])
        sums, counts = np.zeros_like(centers), np.bincount(own, minlength=words)
        np.add.at(sums, own, rows)
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


class MultiIndex:
    """Codebooks of the two halves, the number of cells to visit, and the groups of cells."""

    def __init__(self, sample: np.ndarray, words: int, threshold: float, recall: float, many: int):
        self.cut, self.words = sample.shape[1] // 2, max(1, min(words, len(sample)))
        self.books = (codebook(sample[:, : self.cut], self.words), codebook(sample[:, self.cut :], self.words))
        self.visits = self._calibrated(sample[:TRIALS], threshold, recall)
        # pairs of ranks in the two halves whose product is at most v hold the first v cells
        pairs = [(a, b) for a in range(min(self.words, self.visits)) for b in range(min(self.words, self.visits // (a + 1)))]
        self.ranks = np.array(pairs, dtype=np.int64).T
        # a first code word's cells are cut into parts of about BLOCK vectors
        parts = max(1, round(many / (self.words * BLOCK)))
        self.wide = -(-self.words // parts)

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(rows[:, : self.cut], self.books[0]), squared(rows[:, self.cut :], self.books[1])

    def traverse(self, rows: np.ndarray) -> np.ndarray:
        """The first cells in multi-sequence order; the first is the row's own."""
        return np.concatenate([np.zeros((0, self.visits), dtype=np.int64), *[self._traverse(x) for x in _chunks(rows, max(self.words, self.ranks.shape[1]))]])

    def _traverse(self, rows: np.ndarray) -> np.ndarray:
        first, second = self.distances(rows)
        i, j = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
        left, right = i[:, self.ranks[0]], j[:, self.ranks[1]]
        sums = np.take_along_axis(first, left, axis=1) + np.take_along_axis(second, right, axis=1)
        order = np.argsort(sums, axis=1, kind="stable")[:, : self.visits]
        return np.take_along_axis(left * self.words + right, order, axis=1)

    def group(self, cells: np.ndarray) -> np.ndarray:
        return (cells // self.words) * self.words + cells % self.words // self.wide

    def _calibrated(self, rows: np.ndarray, threshold: float, recall: float) -> int:
        """Visits by which a vector or its turned one meets the other's cell."""
        turn = np.random.default_rng(0).standard_normal(rows.shape)
        turn -= (turn * rows).sum(axis=1, keepdims=True) * rows
        norm = np.linalg.norm(turn, axis=1, keepdims=True)
        turned = threshold * rows + np.sqrt(1 - threshold**2) * turn / np.where(norm > 0, norm, 1)
        ends = [[x.argmin(axis=1) for x in self.distances(y)] for y in (turned, rows)]
        ranks = np.minimum(*[self._places(x, *end) for x, end in zip((rows, turned), ends, strict=True)])
        return max(1, int(np.quantile(ranks, recall, method="higher")))

    def _places(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each row how many cells are no further than the cell (a, b)."""
        out = np.zeros(len(rows), dtype=np.int64)
        for k, (first, second) in enumerate(zip(*self.distances(rows), strict=True)):
            reach = first[a[k]] + second[b[k]] - first
            out[k] = np.searchsorted(np.sort(second), reach + 1e-12, side="right").sum()
        return out


class Flat:
    """The index of few vectors: one cell."""

    def traverse(self, rows: np.ndarray) -> np.ndarray:
        return np.zeros((len(rows), 1), dtype=np.int64)

    def group(self, cells: np.ndarray) -> np.ndarray:
        return cells


def build_indexes(classes: DataFrame, dtype: str, threshold: float, recall: float) -> dict[int, MultiIndex]:
    """An index for each length (in bytes) with enough vectors for several cells."""
    sizes = classes.groupBy(F.octet_length("vec").alias("bytes")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 3 * PER_CELL)
    out = {}
    for row in sizes.orderBy("bytes").collect():
        words = int(max(1, min(MOST_WORDS, round((row["n"] / PER_CELL) ** 0.5))))
        most = max(LEAST_SAMPLE, min(SAMPLE, 4 * words))
        sample = classes.where(F.octet_length("vec") == row["bytes"]).orderBy(F.xxhash64("vec"), "vec").limit(most).select("vec").toPandas()
        if row["bytes"] >= 2 * np.dtype(dtype).itemsize:
            out[row["bytes"]] = MultiIndex(unit(_rows(sample["vec"], dtype)), words, threshold, recall, row["n"])
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links (a, b) and the smallest node that it reaches by them."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _met(rows: np.ndarray, home: np.ndarray, x: np.ndarray, q: np.ndarray, cells: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asking row of q, held row of x) that reach the threshold, cell by cell. cells: those
    that each row of q visits."""
    asking, visited = np.repeat(q, [len(c) for c in cells]), np.concatenate(cells)
    order, held = np.argsort(visited, kind="stable"), x[np.argsort(home[x], kind="stable")]
    asking, visited, homes = asking[order], visited[order], home[held]
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    both = np.intersect1d(visited, homes)
    ends = [np.searchsorted(a, both, side=side) for a in (visited, homes) for side in ("left", "right")]
    for a, b, c, d in zip(*ends, strict=True):
        j = held[c:d]
        others = rows[j].T
        for part in _chunks(asking[a:b], len(j)):
            i, k = np.nonzero(rows[part] @ others >= threshold)
            left.append(part[i])
            right.append(j[k])
    return np.concatenate(left), np.concatenate(right)


def _verify(dtype: str, threshold: float):
    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        rows, cls, mult, home = unit(_rows(pdf["vec"], dtype)), pdf["cls"].to_numpy(), pdf["mult"].to_numpy(), pdf["home"].to_numpy()
        held, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
        if not len(held) or not len(asking):
            return pd.DataFrame({"cls": [], "links": [], "root": []}, dtype=np.int64)
        # an asking row has the cells of this group that it visits, a held row all that it visits
        cells = pdf["cells"].to_numpy()
        q, x = _met(rows, home, held, asking, list(cells[asking]), threshold)
        path, place = np.stack(list(cells[held])), np.zeros(len(rows), dtype=np.int64)
        place[held] = np.arange(len(held))
        # a pair that meets in both cells counts where the smaller class asks
        twice = np.concatenate([np.zeros(0, dtype=bool), *[(path[place[x[p]]] == home[q[p]][:, None]).any(axis=1) for p in _chunks(np.arange(len(q)), path.shape[1])]])
        keep = (cls[q] != cls[x]) & (~twice | (cls[q] < cls[x]))
        q, x = q[keep], x[keep]
        nodes, roots = forest(cls[q], cls[x])
        links = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(links, np.searchsorted(nodes, cls[q]), mult[x])
        np.add.at(links, np.searchsorted(nodes, cls[x]), mult[q])
        return pd.DataFrame({"cls": nodes, "links": links, "root": roots})

    return verify


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding).

    Vectors that are null, empty, zero or not finite link with nothing, and vectors of different
    lengths don't link. Repeated rows are vectors of their own that link with each other; a null
    vec_id takes the smallest vec_id of its component, or null. Labels and other columns aren't
    read. An embedding column of doubles is compared as such. An empty table gives an empty result."""
    spark = vectors.sparkSession
    rows, dtype = packed(vectors)
    rows = materialize(rows, "vectors")
    classes = rows.where("vec IS NOT NULL").groupBy("vec").agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("least"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cls"), "vec", "mult", "least"), "classes")
    sent = spark.sparkContext.broadcast(build_indexes(classes, dtype, threshold, recall))

    def placed(batches):
        names = ["cls", "vec", "mult", "bytes", "home", "own", "path", "goes"]
        for batch in batches:
            vec = batch.column(1).to_pylist()
            sizes = np.array([len(x) for x in vec], dtype=np.int64)
            for size in np.unique(sizes):
                at, index = np.flatnonzero(sizes == size), sent.value.get(int(size), Flat())
                way = index.traverse(unit(_rows([vec[i] for i in at], dtype)))
                groups, n, v = index.group(way), *way.shape
                # each row's cells by group: runs of one group are an entry of the row's list
                order = np.argsort(groups, axis=1, kind="stable")
                into, cells = np.take_along_axis(groups, order, axis=1).ravel(), np.take_along_axis(way, order, axis=1).ravel()
                first = np.arange(n * v) % v == 0
                first[1:] |= into[1:] != into[:-1]
                runs = np.flatnonzero(first)
                lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
                entries = pa.StructArray.from_arrays([pa.array(into[runs]), lists(np.append(runs, n * v), pa.array(cells, pa.int32()))], ["group", "cells"])
                goes = lists(np.append(np.searchsorted(runs, np.arange(n) * v), len(runs)), entries)
                part = batch.take(pa.array(at))
                path = lists(np.arange(n + 1) * v, pa.array(way.ravel(), pa.int32()))
                more = [pa.array(np.full(n, size)), pa.array(way[:, 0]), pa.array(groups[:, 0]), path, goes]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names)

    fields = "cls long, vec binary, mult long, bytes long, home long, own long, path array<int>, goes array<struct<group:long,cells:array<int>>>"
    there = materialize(classes.select("cls", "vec", "mult").mapInArrow(placed, fields), "placed")
    blocks = lambda size: F.ceil(F.count(F.lit(1)) / size).cast("int")
    # groups are about as large as a block; those up to twice as large aren't dealt out
    held = there.groupBy("bytes", F.col("own").alias("group")).agg(blocks(2 * BLOCK).alias("parts"))
    asked = there.select("bytes", F.explode("goes.group").alias("group")).groupBy("bytes", "group").agg(blocks(ASKING).alias("turns"))
    groups = materialize(held.join(asked, ["bytes", "group"]), "groups")
    block = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["bytes", "group", "part", "turn", "asks", "cls", "vec", "mult", "home", "cells"]
    stays = there.withColumnsRenamed({"own": "group", "path": "cells"}).join(groups, ["bytes", "group"]).withColumn("part", block("parts")).withColumn("turn", each("turns")).withColumn("asks", F.lit(False))
    visits = there.select("bytes", "cls", "vec", "mult", "home", F.explode("goes").alias("x")).select("*", "x.group", "x.cells").join(groups, ["bytes", "group"])
    visits = visits.withColumn("turn", block("turns")).withColumn("part", each("parts")).withColumn("asks", F.lit(True))
    both = stays.select(*columns).unionByName(visits.select(*columns))
    met = materialize(both.groupBy("bytes", "group", "part", "turn").applyInPandas(_verify(dtype, threshold), "cls long, links long, root long"), "met")
    labels = components(met.select(F.col("cls").alias("a"), F.col("root").alias("b")).where("a <> b"))
    links = met.groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.join(labels, classes["cls"] == labels["node"], "left").join(links, "cls", "left")
    named = named.select("cls", "least", "vec", F.coalesce("component", "cls").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answers = materialize(named.join(smallest, "component").select(F.col("vec").alias("_vec"), "n", "component_id"), "answers")
    out = rows.join(answers, F.col("vec") == F.col("_vec"), "left")
    component = F.when(F.col("_vec").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() over all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
