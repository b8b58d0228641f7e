"""Exact nearest neighbours under filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.vectors import cosine_distance

#: Vectors that a task compares with as many others at once, and what rounding may add to a distance.
TILE = 4096
SLACK = 1e-9


def knn(rows: DataFrame, query: list[float], k: int, most: float | None = None, ties: tuple[str, ...] | None = None) -> DataFrame:
    """The k rows nearest to a vector by cosine, with their distance; ties by further keys:
    created_at, where rows have it, and id. Filter rows before. Each task keeps k rows, so one pass and no shuffle of vectors."""
    if not 1 <= k <= 100:
        raise ValueError("k is 1 to 100")
    ties = tuple(c for c in ("created_at", "id") if c in rows.columns) if ties is None else ties
    near = rows.where(F.col("embedding").isNotNull()).withColumn("distance", cosine_distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])))
    return (near if most is None else near.where(F.col("distance") <= most)).orderBy("distance", *ties).limit(k)


def search(rows: DataFrame, query: list[float], top_k: int = 10, distance: float | None = None) -> DataFrame:
    """knn() as callers ask for it: ten rows if they don't say how many, a distance of 0 to 1."""
    if distance is not None and not 0 <= distance <= 1:
        raise ValueError("distance is 0 to 1")
    return knn(rows, query, top_k, distance)


def _tiles(rows: DataFrame, key: str, block: list[str]) -> DataFrame:
    """One row for each tile of a block's vectors: (block, tile, tiles, keys, vectors); vectors with
    null components are left out, those of another length are another block. Tiles have about
    ``TILE`` rows, so what a task holds doesn't grow with the block."""
    whole = rows.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    whole = whole.select(F.to_json(F.struct(*block, F.size("embedding").alias("_size"))).alias("block"), F.col(key).alias("key"), "embedding")
    counts = whole.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    dealt = whole.join(counts, "block").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    tiles = dealt.groupBy("block", "tile", "tiles").agg(F.collect_list(F.struct("key", "embedding")).alias("x"))
    return tiles.select("block", "tile", "tiles", F.transform("x", lambda x: x["key"]).alias("keys"), F.flatten(F.transform("x", lambda x: x["embedding"].cast("array<double>"))).alias("vectors"))


def _unit(pdf: pd.DataFrame) -> tuple[list, np.ndarray]:
    keys = list(pdf["keys"].iloc[0])
    vectors = np.array(pdf["vectors"].iloc[0], dtype=np.float64).reshape(len(keys), -1)
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return keys, np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms != 0)


def _close(cosine: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have any distance within ``most``, and their distances; most rows have none
    and are passed once."""
    at = np.flatnonzero(1 - np.fmax.reduce(cosine, axis=1) <= most + SLACK)
    return at, 1 - cosine[at]


def nearest(probes: DataFrame, rows: DataFrame, block: list[str], most: float, key: str = "id", apart: bool = False) -> DataFrame:
    """For each probe (probe, block columns, embedding) the nearest row of its block within
    ``most``, ties by key: (probe, key, distance). All pairs are compared, a tile of probes with a
    tile of rows at a time; those that can be a probe's nearest are measured exactly. ``apart``:
    probes are rows themselves, and a row with the probe's key isn't meant."""
    once = rows.where(F.col("embedding").isNotNull())
    once = once.select(*block, key, "embedding") if apart else once.groupBy(*block, "embedding").agg(F.min(key).alias(key))
    left, right = _tiles(probes, "probe", block), _tiles(once, key, block)
    n_left, n_right = left.select("block", F.col("tiles").alias("n")).distinct(), right.select("block", F.col("tiles").alias("n")).distinct()
    a = left.join(n_right, "block").select("block", F.col("tile").alias("l"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("r"), "keys", "vectors")
    b = right.join(n_left, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("l"), F.col("tile").alias("r"), "keys", "vectors")
    kinds = [x.schema["keys"].dataType.elementType.simpleString() for x in (left, right)]

    def compare(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(one) and len(other):
            (ids, u), (others, v) = _unit(one), _unit(other)
            for i in range(0, len(ids), 512):
                at, distance = _close(u[i : i + 512] @ v.T, most)
                if not len(at):
                    continue
                if apart:
                    distance[np.array(ids[i : i + 512], dtype=object)[at, None] == np.array(others, dtype=object)] = np.inf
                near = distance <= np.minimum(most, np.nanmin(np.where(np.isnan(distance), np.inf, distance), axis=1))[:, None] + SLACK
                found += [(ids[i + at[x]], others[y]) for x, y in np.argwhere(near)]
        return pd.DataFrame(found, columns=["probe", "_key"], dtype=object)

    pairs = a.groupBy("block", "l", "r").cogroup(b.groupBy("block", "l", "r")).applyInPandas(compare, f"probe {kinds[0]}, _key {kinds[1]}")
    pairs = pairs.join(probes.select("probe", F.col("embedding").alias("_embedding")), "probe")
    pairs = pairs.join(once.select(F.col(key).alias("_key"), "embedding"), "_key").withColumn("distance", cosine_distance(F.col("embedding"), F.col("_embedding")))
    best = pairs.where(F.col("distance") <= most).groupBy("probe").agg(F.min(F.struct("distance", F.col("_key").alias(key))).alias("x"))
    return best.select("probe", F.col(f"x.{key}").alias(key), "x.distance")


def linked(rows: DataFrame, block: list[str], most: float, key: str = "id") -> DataFrame:
    """Links (a, b) of one block that connect just what pairs within ``most`` connect (or by
    ``SLACK`` more). All pairs are compared, two tiles at a time; of each two tiles' links those of
    a spanning forest are kept, so that a large group of near copies doesn't expand into pairs."""
    tiles = _tiles(rows, key, block)
    kind = tiles.schema["keys"].dataType.elementType.simpleString()
    a = tiles.select("block", F.col("tile").alias("l"), F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("r"), "keys", "vectors")
    b = tiles.select("block", F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("l"), F.col("tile").alias("r"), "keys", "vectors").toDF("block", "l", "r", "keys", "vectors")

    def compare(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        (ids, u), (others, v) = _unit(one), _unit(other)
        left, free, found = np.ones(len(ids), dtype=bool), np.ones(len(others), dtype=bool), []
        near = np.zeros((len(ids), len(others)), dtype=bool)
        for i in range(0, len(ids), 512):
            at, distance = _close(u[i : i + 512] @ v.T, most)
            near[i + at] = distance <= most + SLACK
        for start in np.flatnonzero(near.any(axis=1)):
            todo = [start] if left[start] else []
            left[start] = False
            while todo:
                x = todo.pop()
                for y in np.flatnonzero(near[x] & free):
                    free[y] = False
                    found.append((ids[x], others[y]))
                    more = np.flatnonzero(near[:, y] & left)
                    left[more] = False
                    found += [(ids[z], others[y]) for z in more]
                    todo += more.tolist()
        return pd.DataFrame([p for p in found if p[0] != p[1]], columns=["a", "b"], dtype=object)

    return a.groupBy("block", "l", "r").cogroup(b.groupBy("block", "l", "r")).applyInPandas(compare, f"a {kind}, b {kind}")


def pairs_within(rows: DataFrame, block: list[str], most: float) -> DataFrame:
    """Pairs (a, b, distance), a < b, of one block with a distance of at most ``most``. All pairs are
    compared, two tiles at a time, but only those that may be near enough leave a task; they are
    measured exactly then."""
    tiles = _tiles(rows, "id", block)
    kind = tiles.schema["keys"].dataType.elementType.simpleString()
    a = tiles.select("block", F.col("tile").alias("l"), F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("r"), "keys", "vectors")
    b = tiles.select("block", F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("l"), F.col("tile").alias("r"), "keys", "vectors").toDF("block", "l", "r", "keys", "vectors")

    def compare(key: tuple, one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        (ids, u), (others, v) = _unit(one), _unit(other)
        found = []
        for i in range(0, len(ids), 512):
            for x, y in np.argwhere(1 - u[i : i + 512] @ v.T <= most + SLACK):
                if key[1] < key[2] or ids[i + x] < others[y]:
                    found.append(tuple(sorted((ids[i + x], others[y]))))
        return pd.DataFrame(found, columns=["a", "b"], dtype=object)

    pairs = a.groupBy("block", "l", "r").cogroup(b.groupBy("block", "l", "r")).applyInPandas(compare, f"a {kind}, b {kind}")
    side = lambda name, column: rows.select(F.col("id").alias(name), F.col("embedding").alias(column))
    found = pairs.join(side("a", "_one"), "a").join(side("b", "_other"), "b").select("a", "b", cosine_distance(F.col("_one"), F.col("_other")).alias("distance"))
    return found.where(F.col("distance") <= most)
