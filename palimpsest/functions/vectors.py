"""Vector functions over arrays of floats, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a norm is zero or the lengths differ."""
    both = norm(a) * norm(b)
    return F.when((both > 0) & (F.size(a) == F.size(b)), 1 - dot(a, b) / both)


def nonzero(a: Column) -> Column:
    return F.exists(a, lambda x: x != 0)


def normalise(a: Column) -> Column:
    """A unit vector; non-finite components become 0, and a vector of almost no length stays."""
    finite = F.transform(a, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double")))
    length = norm(finite)
    return F.when(length < 1e-10, finite).otherwise(F.transform(finite, lambda x: x / length))
