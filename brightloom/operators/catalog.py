"""Table inventory, descriptions, column profiles and frequent values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from brightloom.functions.ranking import top_k

_NUMERIC = (T.NumericType,)


def resolve(name: str, candidates: Sequence[str], what: str = "table") -> str:
    """Trimmed, case-insensitive lookup; an unknown name lists the candidates."""
    found = {c.lower(): c for c in candidates}.get(name.strip().lower())
    if found is None:
        raise ValueError(f"no {what} named {name!r}; there are {', '.join(candidates)}")
    return found


def catalog_tables(spark: SparkSession) -> dict[str, DataFrame]:
    names = sorted(t.name for t in spark.catalog.listTables())
    return {n: spark.table(n) for n in names}


def inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Name, column count and row count per table: one count job per table, one result."""
    rows = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("columns"), "rows"
        )
        for name, df in sorted(tables.items())
    ]
    return reduce(DataFrame.unionByName, rows)


def describe(df: DataFrame, primary_key: Sequence[str] = ()) -> DataFrame:
    """Column name, type, nullability and key membership (schema only, no scan)."""
    keys = set(primary_key)
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable, f.name in keys) for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, column_name string, type string, nullable boolean, primary_key boolean"
    )


def sample_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def _is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, _NUMERIC)


def column_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Value counts of many columns from one scan: (column_name, num, txt, value, n).

    ``value`` is the exact native value as text and decides what is distinct;
    ``num`` is its double for numeric columns, ``txt`` the text of all others.
    Counts combine on the map side, so a value that fills a third of the table
    costs one row per task.
    """
    names = [resolve(c, df.columns, "column") for c in (columns or df.columns)]
    fields = {f.name: f for f in df.schema.fields}

    def cell(c: str) -> Column:
        numeric, value = _is_numeric(fields[c]), F.col(f"`{c}`")
        if isinstance(fields[c].dataType, (T.DoubleType, T.FloatType)):
            value = value + F.lit(0.0).cast(fields[c].dataType)  # one zero
        text = value.cast("string")
        return F.struct(
            F.lit(c).alias("column_name"), (value.cast("double") if numeric else F.lit(None).cast("double")).alias("num"),
            (F.lit(None).cast("string") if numeric else text).alias("txt"), text.alias("value"),
        )

    return (
        df.select(F.explode(F.array(*[cell(c) for c in names])).alias("c"))
        .select("c.*")
        .groupBy("column_name", "num", "txt", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, nulls, distinct values, range, mean and population deviation per column.

    One aggregate over native values gives everything but the distinct counts,
    without a shuffle of cells; those come from the value counts. Deviations of
    longs and decimals, which a double may not hold, are taken from the exact
    differences to the column's minimum.
    """
    names = [resolve(c, df.columns, "column") for c in (columns or df.columns)]
    fields = {f.name: f for f in df.schema.fields}
    wide = {c: f"_low_{i}" for i, c in enumerate(names) if isinstance(fields[c].dataType, (T.LongType, T.DecimalType))}
    none, nothing = F.lit(None).cast("double"), F.lit(None).cast("string")

    def spread(c: str) -> Column:
        if c not in wide:
            return F.stddev_pop(F.col(f"`{c}`"))
        exact = fields[c].dataType if isinstance(fields[c].dataType, T.DecimalType) else T.DecimalType(20, 0)
        return F.stddev_pop((F.col(f"`{c}`").cast(exact) - F.col(wide[c]).cast(exact)).cast("double"))

    def row(c: str) -> Column:
        col, numeric = F.col(f"`{c}`"), _is_numeric(fields[c])
        return F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("total_rows"), F.count(col).alias("non_null"),
            (F.avg(col).cast("double") if numeric else none).alias("mean"),
            (spread(c) if numeric else none).alias("std"),
            (F.min(col).cast("double") if numeric else none).alias("min_num"),
            (F.max(col).cast("double") if numeric else none).alias("max_num"),
            (nothing if numeric else F.min(col.cast("string"))).alias("min_text"),
            (nothing if numeric else F.max(col.cast("string"))).alias("max_text"),
        )

    based = df.crossJoin(F.broadcast(df.agg(*[F.min(f"`{c}`").alias(low) for c, low in wide.items()]))) if wide else df  # one row
    summary = based.agg(F.array(*[row(c) for c in names]).alias("rows")).select(F.inline("rows"))
    distinct = column_values(df, names).groupBy("column_name").agg(F.count("value").alias("distinct_values"))
    return summary.join(distinct, "column_name", "left").select(
        "column_name", "total_rows", "non_null", (F.col("total_rows") - F.col("non_null")).alias("nulls"),
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), F.round("mean", 4).alias("mean"),
        F.round("std", 4).alias("std"), "min_num", "max_num", "min_text", "max_text",
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The ``k`` most frequent non-null values per column; ties by value, ascending."""
    counts = column_values(df, columns).where(F.col("value").isNotNull())
    ranked = top_k(counts, ["column_name"], [F.desc("n"), F.asc("num"), F.asc("value")], k)
    return ranked.select("column_name", "rank", F.col("num").alias("num_value"), F.col("txt").alias("text_value"), "n")
