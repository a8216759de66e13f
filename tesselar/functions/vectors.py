"""Arithmetic on arrays of numbers and on scores of a query."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision, summed from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """v over its length, which counts as 1e-9 at least."""
    n = F.greatest(norm(v), F.lit(1e-9))
    return F.transform(v, lambda x: x / n)


def is_zero(v: Column, tiny: float = 1e-6) -> Column:
    """Whether a vector says nothing: its length is `tiny` at most."""
    return norm(v) <= tiny


def minmax(score: Column, by: str | list[str] = "qid") -> Column:
    """(score - lowest) / (highest - lowest) among the rows of a query; 0 where all are alike."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < 1e-9, F.lit(0.0)).otherwise((score - low) / F.greatest(high - low, F.lit(1e-9)))


def zscore(score: Column, by: str | list[str] = "qid") -> Column:
    """Standard deviations from the mean of a query's rows; 0 where all are alike."""
    w = Window.partitionBy(by)
    sd = F.stddev_pop(score).over(w)
    return F.when(sd < 1e-9, F.lit(0.0)).otherwise((score - F.avg(score).over(w)) / F.greatest(sd, F.lit(1e-9)))


NORMALISERS = {"minmax": minmax, "zscore": zscore}
