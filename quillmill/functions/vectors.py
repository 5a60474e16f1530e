"""Vectors: hashed features in Arrow, algebra in Catalyst."""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: FNV-1a, 64 bits (fixed values).
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
DIM = 256
RUNS = regex.compile(r"[\p{Alphabetic}\p{N}]+")


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


class HashEmbedder:
    """Signed feature hashing of words and neighbouring pairs, of unit length; a text without words is the zero vector."""

    def __init__(self, dim: int = DIM):
        self.dim, self.known = dim, {}

    def _cell(self, feature: str) -> tuple[int, float]:
        got = self.known.get(feature)
        if got is None:
            h = fnv1a(feature.encode())
            if len(self.known) > 300_000:
                self.known.clear()
            got = self.known[feature] = (h % self.dim, -1.0 if h >> 63 else 1.0)
        return got

    def __call__(self, text: str | None) -> np.ndarray:
        v = np.zeros(self.dim, np.float32)
        words = [w.lower() for w in RUNS.findall(text or "")]
        for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
            i, sign = self._cell(f)
            v[i] += sign
        n = np.float32(np.linalg.norm(v))
        return v / n if n else v


def hash_embedding(c: Column | str, dim: int = DIM) -> Column:
    """``array<float>`` of a text column."""

    @pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        embed = HashEmbedder(dim)
        return texts.map(embed)

    return run(F.col(c) if isinstance(c, str) else c)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for different lengths or a zero vector."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)
