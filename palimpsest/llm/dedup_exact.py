"""Exact dedup against a corpus already seen, by a minimal perfect hash.

The distinct digests of the historical part are dealt into shards of a few thousand; each shard
gets a minimal perfect hash (compress, hash and displace): as many slots as digests, each with
the full 32-byte digest, the locator of its winner and its count. A lookup goes to one slot and
compares all bytes of the digest, so nothing that isn't a member passes. Groups of arriving rows
are formed by digest first, with partial sums, so each distinct digest is looked up once however
many copies it has; those that aren't members form groups of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, parts_for, table

SHARD_KEYS = 4096
_INDEX = "shard long, salt long, seeds array<long>, digests binary, winners array<long>, counts array<long>"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, copies): SHA-256 of the text with A-Z lower-cased; null counts as empty.
    Rows that repeat both doc_id and text are one document with so many copies."""

    def hashed(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            out = [hashlib.sha256((x or b"").lower()).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, digest binary").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))


def _mixed(keys: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three 64-bit words of each digest (n x 4 words), stirred by salt."""
    words = keys[:, 1:4].copy()
    with np.errstate(over="ignore"):
        words ^= np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        words ^= words >> np.uint64(31)
        words *= np.uint64(0xBF58476D1CE4E5B9)
        words ^= words >> np.uint64(29)
    return words[:, 0], words[:, 1], words[:, 2]


def _places(first: np.ndarray, second: np.ndarray, seed: np.ndarray | int, slots: int) -> np.ndarray:
    """The slot of each key under its bucket's seed (a stride and a shift)."""
    seed = np.asarray(seed, dtype=np.int64)
    a, b = (first % np.uint64(slots)).astype(np.int64), (second % np.uint64(slots)).astype(np.int64)
    return (a + b * (seed // slots) + seed % slots) % slots


def build_hash(keys: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(salt, seed of each bucket, slot of each key) for distinct digests as rows of four words."""
    n = len(keys)
    buckets = max(1, n // 3)
    for salt in range(1000):
        first, second, third = _mixed(keys, salt)
        bucket = (third % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        sizes = np.diff(starts)
        seeds, slot, taken = np.zeros(buckets, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        free: list[int] = []
        for k in np.argsort(-sizes, kind="stable"):
            own = order[starts[k] : starts[k + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:
                free = free or list(np.flatnonzero(~taken))
                place = free.pop()
                seeds[k] = (place - int(first[own[0]] % np.uint64(n))) % n
                slot[own], taken[place] = place, True
                continue
            for low in range(0, n * n, 256):
                seed = np.arange(low, min(low + 256, n * n))
                places = _places(first[own][None, :], second[own][None, :], seed[:, None], n)
                fits = ~taken[places].any(axis=1)
                fits &= (np.diff(np.sort(places, axis=1), axis=1) > 0).all(axis=1)
                if fits.any():
                    i = int(np.argmax(fits))
                    seeds[k], slot[own] = seed[i], places[i]
                    taken[places[i]] = True
                    break
            else:
                break
        else:
            k = -1
        if taken.all():
            return salt, seeds, slot
    raise RuntimeError("no perfect hash found")


def _words(column) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in column), dtype="<u8").reshape(-1, 4)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _words(pdf["digest"])
    salt, seeds, slot = build_hash(keys)
    at = np.argsort(slot)
    one = {"shard": pdf["shard"].iloc[0], "salt": salt, "seeds": seeds, "digests": keys[at].tobytes(), "winners": pdf["winner"].to_numpy()[at], "counts": pdf["n"].to_numpy()[at]}
    return pd.DataFrame([one])


def _look(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = asked[["digest", "newest", "n"]].copy()
    out["winner"], out["known"] = pd.array([pd.NA] * len(out), dtype="Int64"), 0
    if len(asked) and len(index):
        row, keys = index.iloc[0], _words(asked["digest"])
        held = np.frombuffer(bytes(row["digests"]), dtype="<u8").reshape(-1, 4)
        seeds = np.asarray(row["seeds"], dtype=np.int64)
        first, second, third = _mixed(keys, int(row["salt"]))
        slot = _places(first, second, seeds[(third % np.uint64(len(seeds))).astype(np.int64)], len(held))
        member = (held[slot] == keys).all(axis=1)
        winners, counts = np.asarray(row["winners"], dtype=np.int64), np.asarray(row["counts"], dtype=np.int64)
        out["winner"] = pd.array(np.where(member, winners[slot], 0), dtype="Int64")
        out.loc[~member, "winner"] = pd.NA
        out["known"] = np.where(member, counts[slot], 0)
    return out


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("long")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index over ``history`` (digest, winner long, n long; distinct digests): a row for each
    shard that any of them is in."""
    dealt = history.withColumn("shard", _shard(shards))
    return materialize(dealt.groupBy("shard").applyInPandas(_build, _INDEX), "mph")


def exact_dedup(keyed: DataFrame, known_until: int | None) -> DataFrame:
    """Decides for every document of ``keyed`` (see digests()). Documents with
    doc_id <= known_until are the history, the others (and null doc_ids) arrive.

    Returns doc_id, digest, copies, keep_id, group_size (rows, repeats counted), kept. The largest
    doc_id of equal texts stays; where all of them are null, keep_id is null and none is lost:
    kept is then true. An empty table gives an empty result."""
    old = F.coalesce(F.col("doc_id") <= F.lit(known_until).cast("long"), F.lit(False))
    history = keyed.where(old).groupBy("digest").agg(F.max("doc_id").alias("winner"), F.sum("copies").alias("n"))
    history = materialize(history, "history")
    fresh = materialize(keyed.where(~old).groupBy("digest").agg(F.max("doc_id").alias("newest"), F.sum("copies").alias("n")), "fresh")
    # a shard's members and its lookups are both bounded, also where there is little history or much
    shards = parts_for(max(history.count(), fresh.count()), SHARD_KEYS)
    index = build_index(history, shards)
    fresh = fresh.withColumn("shard", _shard(shards))
    found = fresh.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_look, "digest binary, newest long, n long, winner long, known long")
    fresh_groups = materialize(found.select("digest", F.greatest("newest", "winner").alias("keep_id"), (F.col("n") + F.col("known")).alias("group_size")), "looked-up")
    old_groups = history.join(fresh_groups.select("digest"), "digest", "left_anti").select("digest", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"))
    groups = fresh_groups.unionByName(old_groups)
    out = keyed.join(groups, "digest", "left")
    return out.select("doc_id", "digest", "copies", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def middle_id(docs: DataFrame) -> int | None:
    """Half-way between the smallest and the largest doc_id: the older half is the history."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return None if low is None else int(low + (high - low) // 2)


def dedup_documents(docs: DataFrame) -> DataFrame:
    """exact_dedup() of docs (doc_id, text), whose older half is the history. Rows that repeat
    both doc_id and text are one row here, with their number in ``copies``."""
    keyed = materialize(digests(docs), "digests")
    return exact_dedup(keyed, middle_id(keyed))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_documents() over all documents, with a row for each row of the table: rows that repeat
    both doc_id and text have the same answer."""
    out = dedup_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    out = out.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
