"""Vector functions."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; 1 where either vector is zero, never -0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 1.0).otherwise(1 - dot(a, b) / norms) + F.lit(0.0)


def deterministic_embedding(text: str, dims: int) -> list[float]:
    """A unit vector that depends on the text alone: SHA-256 over a block number and the text gives
    eight components a block."""
    raw: list[int] = []
    block = 0
    while len(raw) < dims:
        raw.extend(struct.unpack("<8I", hashlib.sha256(struct.pack("<i", block) + text.encode()).digest()))
        block += 1
    vector = (np.array(raw[:dims], dtype=np.float64) / 4294967295 * 2 - 1).astype(np.float32)
    norm = np.float32(np.sqrt((vector.astype(np.float64) ** 2).sum()))
    return (vector / norm).tolist() if norm > 0 else vector.tolist()


def embed(text: Column, dims: int) -> Column:
    """deterministic_embedding() as a column; another model can stand in its place."""
    return F.pandas_udf(lambda s: s.map(lambda x: deterministic_embedding(x or "", dims)), "array<float>")(text)
