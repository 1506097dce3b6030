"""Ranks and running totals that survive one huge group. (Exact quantiles: see ``radix``.)

A plain ``Window.partitionBy(key).orderBy(value)`` sends a whole group to one
task. The helpers here cut each group into ordered slices first, total the
slices, and run the window inside a slice only, so a key that holds a third of
all rows is still spread over the cluster. Results are exact: the slice edges
come from a sketch, but any increasing edges give the same answer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_BLOCK = 16  # edges per block of the two-step slice search


def slice_count(df: DataFrame) -> int:
    """Slices per group: as many as the cluster runs shuffle partitions, so one group can use them all."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _slice_of(value: Column) -> Column:
    """Number of ``_edges`` below ``value``: every 16th edge first, then one block of 16."""
    block = F.size(F.filter("_coarse", lambda e: e < value))
    fine = F.slice("_edges", block * _BLOCK + 1, F.lit(_BLOCK))
    return block * _BLOCK + F.size(F.filter(fine, lambda e: e < value))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows per key. Spark trims each partition to ``k`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, name: str = "n") -> DataFrame:
    """One row per key and non-null value; combined on the map side."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(name))


def running_totals(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Sequence[str],
    slices: int | None = None,
) -> DataFrame:
    """Running totals of ``measures`` in ``value`` order inside each key.

    Adds ``cum_<m>`` (inclusive) and ``all_<m>`` (key total). ``counts`` holds
    one row per key and value. The edge and slice tables have a number per
    shuffle partition and key; Spark chooses how to join them by their size.
    """
    slices = slices or slice_count(counts)
    keys = list(keys)
    base = counts if keys else counts.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    cuts = [i / slices for i in range(1, slices)]
    edges = base.groupBy(*by).agg(
        F.percentile_approx(F.col(value), cuts, F.lit(slices * 20)).alias("_edges")
    ).withColumn("_coarse", F.filter("_edges", lambda e, i: i % _BLOCK == _BLOCK - 1))
    cut = base.join(edges, by).withColumn("_slice", _slice_of(F.col(value))).drop("_edges", "_coarse")
    per_slice = cut.groupBy(*by, "_slice").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    order = Window.partitionBy(*by).orderBy("_slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_slice.select(
        *by,
        "_slice",
        *[f"_s_{m}" for m in measures],
        *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(whole).alias(f"all_{m}") for m in measures],
    )
    offsets = offsets.drop(*[f"_s_{m}" for m in measures])
    inside = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(offsets, [*by, "_slice"])
    for m in measures:
        out = out.withColumn(f"cum_{m}", F.sum(m).over(inside) + F.col(f"_o_{m}"))
    return out.drop("_slice", *[f"_o_{m}" for m in measures], *([] if keys else ["_all"]))


def shuffled_rank(df: DataFrame, strata: Sequence[str], row_id: str, seed: int | str) -> DataFrame:
    """Seeded random order inside each stratum: adds ``rank`` (1-based) and ``stratum_n``.

    The order is that of ``md5(seed:id)``. Its first hex digits cut a stratum
    into equal slices, already in the right order: as many digits as it takes
    to have a slice per shuffle partition.
    """
    mixed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")).cast("binary")))
    digits = math.ceil(math.log(slice_count(df), 16))
    mixed = mixed.withColumn("_slice", F.substring("_h", 1, digits))
    sizes = mixed.groupBy(*strata, "_slice").agg(F.count(F.lit(1)).alias("_m"))
    order = Window.partitionBy(*strata).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *strata,
        "_slice",
        F.coalesce(F.sum("_m").over(order), F.lit(0)).alias("_o"),
        F.sum("_m").over(Window.partitionBy(*strata)).alias("stratum_n"),
    )
    inside = Window.partitionBy(*strata, "_slice").orderBy("_h", row_id)
    return (
        mixed.join(offsets, [*strata, "_slice"])
        .withColumn("rank", F.row_number().over(inside) + F.col("_o"))
        .drop("_h", "_slice", "_o")
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "row_no", big: int = 1_000_000
) -> DataFrame:
    """``row_number`` from 1 by a numeric, per-key unique ``order`` column.

    Groups above ``big`` rows are counted first and numbered slice by slice;
    there are at most ``rows / big`` of them. The others use a plain window.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > big).select(*keys)
    plain = df.join(sizes, list(keys), "left_anti").withColumn(
        name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long")
    )
    large = running_totals(
        df.join(sizes, list(keys), "left_semi").withColumn("_one", F.lit(1).cast("long")), keys, order, ["_one"]
    )
    return plain.unionByName(large.withColumnRenamed("cum__one", name).drop("_one", "all__one"))
