"""Vector functions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Zero where either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """``cosine``, or ``one_minus_l2sq``: one less the squared distance, which for unit vectors
    is twice the cosine less one."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "one_minus_l2sq":
        return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    raise ValueError(f"unknown metric: {metric}")


def mean(vectors: Column) -> Column:
    """The mean of an array of vectors of equal length; null of none."""
    n = F.size(vectors)
    rest = F.slice(vectors, 2, F.greatest(n - 1, F.lit(0)))
    summed = F.aggregate(rest, F.get(vectors, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(summed, lambda x: x / n)
