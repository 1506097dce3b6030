"""Column helpers for numeric arrays (computed in double precision)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """L2-normalise; a zero vector stays as it is."""
    length = norm(v)
    return F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))
