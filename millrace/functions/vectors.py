"""Vector functions on array<double>, inside codegen-free but JVM-side higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_embedding(text: Column, dimension: int = 128) -> Column:
    """Deterministic pseudo-embedding: big-endian words of SHA-256 of the lower-case text, scaled to [-1, 1), zero-padded.

    ceil(min(32, dimension) / 4) words are used. Equal up to case gives equal vectors; nothing else is meant.
    """
    words = -(-min(32, dimension) // 4)
    digest = F.sha2(F.lower(text).cast("binary"), 256)
    word = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("double") / F.lit(float(2**32)) * 2 - 1
    values = [word(k) for k in range(words)][:dimension]
    padded = F.array(*values, *[F.lit(0.0)] * (dimension - len(values)))
    return F.when(text.isNotNull(), padded)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def usable(a: Column, dimension: int | None = None) -> Column:
    """Not null, of the dimension, without nulls, NaN or infinities."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sized = (F.size(a) == dimension) if dimension else (F.size(a) > 0)
    return F.coalesce(a.isNotNull() & sized & finite, F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is all zero; null for nulls and for different lengths."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size))
