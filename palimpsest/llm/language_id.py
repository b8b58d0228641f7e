"""Language ID by rank-order profiles.

A profile is a language's most frequent character n-grams (one to three letters, a word's edge
counting as a letter) in order of frequency, counted over all texts that may be learned from. A
document's own most frequent n-grams are compared with each profile: an n-gram costs the distance
between its two ranks, one that a profile lacks costs the profile's full size; the language with
the smallest sum wins, ties going to the smaller name.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import table

PROFILE_SIZE = 400
UNDETERMINED = "und"
#: Letters are at most 21 bits, so three fit a signed 64-bit integer.
_BITS = 21
_HELD_LETTERS, _HELD_GRAMS = 1 << 19, 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    out = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letter_codes(text: str) -> np.ndarray:
    """The text's letters, with one 0 before, after and between words; empty without letters."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]
    codes = np.concatenate(([0], codes, [0]))
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep]
    return codes if len(codes) > 2 else codes[:0]


def ngrams(codes: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of one to three letters; lone word edges and those with an edge inside are left out."""
    a, b, c = codes, codes[1:], codes[2:]
    two = (a[:-1] << _BITS) | b | (1 << 2 * _BITS)
    three = (a[:-2] << 2 * _BITS) ^ (b[:-1] << _BITS) ^ c
    return np.concatenate((a[a != 0], two[(a[:-1] | b) != 0], three[b[:-1] != 0] + (np.int64(1) << 62)))


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first, ties by code."""
    found, counts = np.unique(ngrams(codes), return_counts=True)
    if len(found) > size:  # all that reach the count of the last one kept
        keep = counts >= np.partition(counts, len(counts) - size)[len(counts) - size]
        found, counts = found[keep], counts[keep]
    return found[np.lexsort((found, -counts))][:size]


class GramCounts:
    """Counts of n-grams, summed whenever ``_HELD_LETTERS`` letters have been gathered."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.held = 0
        self.found, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, codes: np.ndarray) -> None:
        self.parts.append(codes)
        self.held += len(codes)
        if self.held > _HELD_LETTERS:
            self.summed()

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            found, counts = np.unique(ngrams(np.concatenate(self.parts)), return_counts=True)
            self.found, at = np.unique(np.concatenate((self.found, found)), return_inverse=True)
            self.counts = np.bincount(at, weights=np.concatenate((self.counts, counts))).astype(np.int64)
        self.parts, self.held = [], 0
        return self.found, self.counts


def learn_profiles(docs: DataFrame, size: int = PROFILE_SIZE) -> dict[str, np.ndarray]:
    """Profiles from all rows of (text, lang) with a lang: whole texts are counted, partial counts
    are summed by (lang, n-gram), and only ``size`` n-grams of each language come to the driver. A
    task hands on what it has counted once it holds ``_HELD_GRAMS`` n-grams."""

    def counted(batches):
        sums: dict[str, GramCounts] = {}

        def handed_on():
            for lang, own in sums.items():
                found, counts = own.summed()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                sums.setdefault(lang.as_py(), GramCounts()).add(letter_codes(text.as_py()))
            if sum(len(own.found) for own in sums.values()) > _HELD_GRAMS:
                yield from handed_on()
        yield from handed_on()

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = rows.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(16))).orderBy(F.desc("n"), "gram")
    last = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("r", F.row_number().over(first)).where(F.col("r") <= size).withColumn("r", F.row_number().over(last)).where(F.col("r") <= size)
    out: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "r").collect():
        out.setdefault(row["lang"], []).append(row["gram"])
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


class RankDistance:
    """Profiles laid side by side, for out-of-place distances to all of them at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE_SIZE):
        self.names, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([profiles[k] for k in self.names])) if profiles else np.zeros(0, dtype=np.int64)
        self.ranks = np.full((len(self.grams), len(self.names)), -1, dtype=np.int64)
        for j, k in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[k]), j] = np.arange(len(profiles[k]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = letter_codes(text or "")
        if not len(codes) or not self.names:
            return UNDETERMINED, 0.0
        own = ranked(codes, self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        ranks = self.ranks[at[known]]
        costs = np.where(ranks >= 0, np.abs(ranks - np.flatnonzero(known)[:, None]), self.size).sum(axis=0) + self.size * int((~known).sum())
        best = int(np.argmin(costs))
        return self.names[best], float(1 - costs[best] / (self.size * len(own)))


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[str], size: int = PROFILE_SIZE, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of docs and, under ``names``, the language and a score (1: the ranks
    agree, 0: nothing in common). Other columns may have any names.

    A null text, or one without letters, is ``und`` with score 0, and so is all where nothing was
    learned. Whole texts are read; repeated rows are answered alike."""

    def predicted(batches):
        model = RankDistance(profiles, size)
        for batch in batches:
            out = [model.predict(x.as_py()) for x in batch.column(at)]
            arrays = [*batch.columns[skip:], pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *names])

    own = [] if "text" in keep else [F.col("text").cast("string").alias("_text")]
    skip, at = len(own), 0 if own else keep.index("text")
    rows = docs.select(*own, *keep)
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    return rows.mapInArrow(predicted, schema)


def held_out(doc_id) -> Column:
    """Documents that nothing is learned from: crc32 of doc_id as text leaves 2 when divided by 4.
    A null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predict_language() over all documents, by profiles of those that aren't held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", held_out("doc_id"))
    profiles = learn_profiles(docs.where("NOT held_out"))
    return predict_language(docs, profiles, ["doc_id", "held_out"])
