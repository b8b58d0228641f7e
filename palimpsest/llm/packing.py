"""Packing pieces of documents into windows of a fixed number of tokens.

Every document's ids (and one end id) are cut into whole windows and one rest. The rests are
packed by non-negative least squares: combinations of up to three lengths that fill a window
exactly are enumerated, repeat counts are fitted so that the lengths used come near the histogram
of rests, rounded down and laid out; what is left is packed greedily. Only the histogram, which
has at most a window's number of entries, comes to the driver; rests are matched with places by
rank within their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bpe import UnitCodec
from palimpsest.llm.common import materialize, parts_for, salted_rank, table

WINDOW = 1024
END_ID = 0
#: Triples are enumerated for this many of the most frequent lengths, pairs for all.
TRIPLE_LENGTHS = 96
#: About so many left-over rests are packed greedily by one task.
GREEDY_ROWS = 20_000


def document_pieces(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, copy, start, length, ids_crc32, doc_tokens): whole windows and one rest of each
    row. A null text is empty and gives the end id alone. ``copy`` tells rows with the same doc_id
    in one task apart."""

    def cut(batches):
        codec, end, row = UnitCodec(), np.array([END_ID], dtype="<u4").tobytes(), 0
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = codec.packed(text or "", end)
                row += 1
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    out.append((doc_id, row, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            arrays = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(histogram: dict[int, int], window: int = WINDOW, triples: int = TRIPLE_LENGTHS) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to the window, from the lengths that occur."""
    have = sorted(histogram)
    out = [(a, window - a, 0) for a in have if a <= window - a and window - a in histogram]
    common = sorted(histogram, key=lambda x: (-histogram[x], x))[:triples]
    seen = {tuple(sorted(x, reverse=True)) for x in out}
    for i, a in enumerate(common):
        for b in common[i:]:
            c = window - a - b
            if c > 0 and c in histogram and (k := tuple(sorted((a, b, c), reverse=True))) not in seen:
                seen.add(k)
                out.append(k)
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def fit_repeats(combos: np.ndarray, histogram: dict[int, int], window: int = WINDOW, rounds: int = 400) -> np.ndarray:
    """How often to lay each combination: min |Ax - h|, x >= 0, where A counts the lengths in each
    combination. Multiplicative updates keep x non-negative and lower the error in every round.
    Rounded down, then trimmed so that no length is used more often than it occurs."""
    if not len(combos):
        return np.zeros(0, dtype=np.int64)
    target = np.zeros(window + 1)
    target[list(histogram)] = list(histogram.values())
    wanted = target[combos] * (combos > 0)
    top = wanted.sum(axis=1)
    x = np.maximum(target[combos[:, 0]] / 2, 1e-9)
    for _ in range(rounds):
        used = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=window + 1)
        used[0] = 0
        x *= top / np.maximum(used[combos].sum(axis=1), 1e-12)
    whole = np.floor(x + 1e-6).astype(np.int64)
    left = target.astype(np.int64)
    for i in np.argsort(-whole, kind="stable"):
        own, need = np.unique(combos[i][combos[i] > 0], return_counts=True)
        whole[i] = max(0, min(int(whole[i]), int((left[own] // need).min())))
        left[own] -= need * whole[i]
    for i in np.argsort(-x, kind="stable"):  # what rounding left: whole combinations that still fit
        own, need = np.unique(combos[i][combos[i] > 0], return_counts=True)
        if (more := int((left[own] // need).min())) > 0:
            whole[i] += more
            left[own] -= need * more
    return whole


def _layout(combos: np.ndarray, repeats: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each run of places, the window that the run's first
    place is in, and the offset there; a run goes through consecutive windows."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    first = np.concatenate(([0], np.cumsum(repeats)))
    for i, combo in enumerate(combos):
        offset = 0
        for length in combo[combo > 0]:
            if repeats[i]:
                runs.setdefault(int(length), []).append((int(repeats[i]), int(first[i]), offset))
            offset += int(length)
    out = {}
    for length, parts in runs.items():
        n, window, offset = (np.array(x, dtype=np.int64) for x in zip(*parts, strict=True))
        out[length] = (np.concatenate(([0], np.cumsum(n))), window, offset)
    return out


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit, longest first: the bin and offset of each length. Bins with equal space are one
    heap entry of a window-sized table, so a length takes at most ``window`` steps."""
    bins, offsets, n = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), 0
    open_by: list[list[int]] = [[] for _ in range(window + 1)]
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        space = next((s for s in range(size, window) if open_by[s]), None)
        if space is None:
            chosen, space, n = n, window, n + 1
        else:
            chosen = open_by[space].pop()
        bins[i], offsets[i] = chosen, window - space
        if space > size:
            open_by[space - size].append(chosen)
    return bins, offsets


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to document_pieces(). Whole windows are sequences of their own;
    ids are disjoint: negative for whole windows, then those of combinations, then the greedy ones."""
    names = ["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens"]
    whole = pieces.where(F.col("length") == window).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rests = pieces.where(F.col("length") < window)
    histogram = {r["length"]: r["n"] for r in rests.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    combos = combinations(histogram, window)
    repeats = fit_repeats(combos, histogram, window)
    layout, placed = _layout(combos, repeats), int(repeats.sum())
    total_left = sum(histogram.values()) - int((repeats[:, None] * (combos > 0)).sum()) if len(combos) else sum(histogram.values())

    def laid(batches):
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            window_of, offset = np.full(len(lengths), -1, dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
            for length in np.unique(lengths):
                if int(length) in layout:
                    edges, windows, offsets = layout[int(length)]
                    at = np.flatnonzero((lengths == length) & (ranks < edges[-1]))
                    run = np.searchsorted(edges, ranks[at], side="right") - 1
                    window_of[at], offset[at] = windows[run] + ranks[at] - edges[run], offsets[run]
            arrays = [batch.column(x) for x in names] + [pa.array(window_of), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{x} long" for x in [*names, "sequence_id", "offset"])
    ranked = salted_rank(rests, ["length"], ["doc_id", "start", "copy"], "rank")
    matched = materialize(ranked.mapInArrow(laid, schema), "laid")
    groups = parts_for(total_left, GREEDY_ROWS)

    def greedy(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "copy"], ascending=[False, True, True, True], ignore_index=True)
        bins, pdf["offset"] = best_fit(pdf["length"].to_numpy(), window)
        pdf["sequence_id"] = placed + bins * groups + key[0]
        return pdf[[*names, "sequence_id", "offset"]]

    left = matched.where("sequence_id < 0").withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "copy"), F.lit(groups)))
    packed = left.groupBy("_group").applyInPandas(lambda key, pdf: greedy(key, pdf.drop(columns="_group")), schema)
    return whole.select(*names, "sequence_id", "offset").unionByName(matched.where("sequence_id >= 0")).unionByName(packed)


def pack_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Packs all rows of docs (doc_id, text); an empty table gives an empty result. Rows that
    repeat a doc_id are packed as documents of their own."""
    return pack(materialize(document_pieces(docs, window), "pieces"), window)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_documents() over all documents."""
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text")).drop("copy")
