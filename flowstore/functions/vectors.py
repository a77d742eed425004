"""Vectors as Columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(v: Column | str | Sequence[float]) -> Column:
    if isinstance(v, Column):
        return v
    return F.col(v) if isinstance(v, str) else F.array(*[F.lit(float(x)) for x in v])


def _pairs(a: Column, b: Column) -> Column:
    """Both cut to the shorter."""
    return F.arrays_zip(F.slice(a, 1, F.least(F.size(a), F.size(b))).alias("x"), F.slice(b, 1, F.least(F.size(a), F.size(b))).alias("y"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    a, b = as_column(a), as_column(b)
    return _sum(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Over the dimensions that both have; 0 for a vector of length 0."""
    a, b = as_column(a), as_column(b)
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    size = norm(x) * norm(y)
    return F.when(size > 0, dot(x, y) / size).otherwise(F.lit(0.0))


def euclidean(a, b) -> Column:
    """Over the dimensions that both have."""
    a, b = as_column(a), as_column(b)
    n = F.least(F.size(a), F.size(b))
    return F.sqrt(_sum(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def normalized(a) -> Column:
    """Of length 1; a vector of length 0 as it is."""
    a = as_column(a)
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def perceptron(weights: Sequence[float], bias: float, inputs) -> Column:
    """1.0 where the weighted sum and the bias are at least 0, else 0.0."""
    return F.when(dot(as_column(weights), as_column(inputs)) + F.lit(float(bias)) >= 0, 1.0).otherwise(0.0)
