"""Customer features, imputation, scaling and stratified folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from brightloom.functions import fixed
from brightloom.functions.radix import quantiles
from brightloom.functions.ranking import shuffled_rank, top_k


def tenure_band(months: Column) -> Column:
    """Right-closed bands: 6 belongs to the first one."""
    out = F.when(months <= fixed.TENURE_EDGES[0], fixed.TENURE_LABELS[0])
    for edge, label in zip(fixed.TENURE_EDGES[1:], fixed.TENURE_LABELS[1:]):
        out = out.when(months <= edge, label)
    return out.when(months.isNotNull(), fixed.TENURE_LABELS[-1])


def engineer(df: DataFrame, tenure: str, spend: str, calls: str) -> DataFrame:
    """Adds tenure_bucket, charges_per_tenure and support_calls_per_year; nulls stay null."""
    months = F.when(F.col(tenure).isNotNull(), F.greatest(F.col(tenure).cast("double"), F.lit(1.0)))
    per_year = F.lit(12.0) * F.col(calls) / months
    return df.withColumns(
        {
            "tenure_bucket": tenure_band(F.col(tenure)),
            "charges_per_tenure": F.col(spend) / months,
            "support_calls_per_year": F.when(
                per_year.isNotNull(), F.least(per_year, F.lit(fixed.CALLS_PER_YEAR_CAP))
            ),
        }
    )


def _unpivot(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast(kind).alias("value")) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where(F.col("value").isNotNull())


def impute_table(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Fill values: exact median for numbers, most frequent (ties: smallest) for strings."""
    medians = quantiles(_unpivot(df, numeric, "double"), ["column_name"], "value", [0.5]).select(
        "column_name", F.col("quantiles")[0].alias("median"), F.lit(None).cast("string").alias("most_frequent")
    )
    counts = _unpivot(df, categorical, "string").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    modes = top_k(counts, ["column_name"], [F.desc("n"), F.asc("value")], 1).select(
        "column_name", F.lit(None).cast("double").alias("median"), F.col("value").alias("most_frequent")
    )
    return medians.unionByName(modes)


def fit_impute(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict:
    """Fitted fill values (one per column) for ``impute``."""
    rows = impute_table(train, numeric, categorical).collect()
    return {r["column_name"]: r["median"] if r["median"] is not None else r["most_frequent"] for r in rows}


def impute(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items() if c in df.columns})


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, one aggregate over the training rows."""
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def scale(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Standardise; a constant column keeps a divisor of 1."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in fitted.items()})


def stratified_holdout(df: DataFrame, label: str, row_id: str, test_size: float, seed: int = 42) -> DataFrame:
    """Adds ``part``: per class exactly round-half-even(n * test_size) test rows."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must be in (0, 1)")
    ranked = shuffled_rank(df, [label], row_id, seed)
    is_test = F.col("rank") <= F.bround(F.col("stratum_n") * test_size)
    return ranked.withColumn("part", F.when(is_test, "test").otherwise("train")).drop("rank", "stratum_n")


def stratified_folds(df: DataFrame, label: str, row_id: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..k-1, classes dealt out evenly."""
    ranked = shuffled_rank(df, [label], row_id, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "stratum_n")
