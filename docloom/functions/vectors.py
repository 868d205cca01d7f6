"""Cosine similarity, means and checks of vectors kept as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine distance; 0 for a zero or empty vector or unequal dimensions, null for null."""
    size = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def valid(v: Column, dimension: int | None = None) -> Column:
    """Not empty, all finite, and of the dimension asked for."""
    ok = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(ok & (F.size(v) == dimension) if dimension else ok, F.lit(False))


def character_vector(text: Column, dimension: int = 16) -> Column:
    """What stands in for an embedding that can't be had: code of each of the first characters modulo 255, over 255."""
    code = lambda i: F.when(i <= F.length(text), (F.ascii(F.substring(text, i, F.lit(1))) % 255) / 255.0).otherwise(0.0)
    return F.transform(F.sequence(F.lit(1), F.lit(dimension)), code)
