"""Vector functions as column expressions over array<float|double>, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Dot product; 0 where the lengths differ."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or the lengths differ."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def mean_pool(matrix: Column) -> Column:
    """Mean of the rows of an array of arrays; raises where the rows differ in length."""
    width = F.size(F.get(matrix, F.lit(0)))
    ragged = F.exists(matrix, lambda r: F.size(r) != width)
    sums = F.aggregate(matrix, F.array_repeat(F.lit(0.0), width), lambda acc, r: F.zip_with(acc, r, lambda x, y: x + y.cast("double")))
    pooled = F.transform(sums, lambda x: x / F.size(matrix))
    return F.when((F.size(matrix) > 0) & ~ragged, pooled).otherwise(F.raise_error(F.lit("cannot pool an empty or ragged matrix")).cast("array<double>"))
