"""Serving counters and cumulative (``le``) histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SCORE_EDGES = tuple(i / 10 for i in range(11))


def request_counts(df: DataFrame, *labels: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("requests"))


def bucket_index(value: Column, edges: Sequence[float]) -> Column:
    """Index of the first edge >= value; ``len(edges)`` is the +Inf bucket."""
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(value <= edges[i], F.lit(i)).otherwise(out)
    return out


def histogram(df: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float]) -> DataFrame:
    """Cumulative buckets (keys…, le, observations), every edge present, +Inf last.

    One partial aggregate with a counter per edge; the wide row is unpivoted after it.
    """
    counters = [F.count_if(F.col(value) <= e).alias(f"_b{i}") for i, e in enumerate(edges)]
    wide = df.groupBy(*keys).agg(*counters, F.count(value).alias(f"_b{len(edges)}"))
    cells = [
        F.struct(F.lit(e).alias("le"), F.col(f"_b{i}").alias("observations"))
        for i, e in enumerate([*(str(float(e)) for e in edges), "+Inf"])
    ]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.le", "c.observations")
