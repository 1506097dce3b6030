"""Instruction examples, prediction pairs, evaluation cases and daily-series files.

Readers return ``(good, rejected)`` pairs of DataFrames instead of raising on
the first bad line: on a large input the caller decides whether rejects stop
the job (``require_clean``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from brightloom.functions import fixed

EXAMPLE_FIELDS = ("id", "category", "instruction", "response")
PREDICTION_FIELDS = ("id", "category", "instruction", "reference", "base_output", "finetuned_output")

EXAMPLE_SCHEMA = T.StructType(
    [T.StructField(f, T.StringType()) for f in EXAMPLE_FIELDS]
    + [T.StructField("meta", T.MapType(T.StringType(), T.StringType()))]
)
PREDICTION_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in PREDICTION_FIELDS])
CASE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("expected_tools", T.ArrayType(T.StringType())),
        T.StructField("expected_answer", T.StringType()),
        T.StructField("reference_trajectory", T.ArrayType(T.StringType())),
    ]
)


class BadRecords(ValueError):
    """Raised by ``require_clean`` and by readers of files that must not be empty."""


def _missing(fields: Sequence[str], blank_counts: bool) -> Column:
    empty = [
        F.when(F.col(f).isNull() | ((F.col(f) == "") if blank_counts else F.lit(False)), F.lit(f)) for f in fields
    ]
    return F.filter(F.array(*empty), lambda name: name.isNotNull())


def _read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return (
        spark.read.schema(with_bad)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


def _split(df: DataFrame, fields: Sequence[str], blank_counts: bool = True) -> tuple[DataFrame, DataFrame]:
    flagged = df.withColumn("_missing", _missing(fields, blank_counts))
    bad = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in df.columns else F.lit(False)
    ok = ~bad & (F.size("_missing") == 0)
    reason = F.when(bad, F.lit("invalid JSON")).otherwise(
        F.concat(F.lit("missing required field(s) "), F.array_join("_missing", ", "))
    )
    good = flagged.where(ok).drop("_missing", "_corrupt_record")
    return good, flagged.where(~ok).withColumn("reason", reason).drop("_missing")


def require_clean(rejected: DataFrame) -> None:
    """Fail with the first reject in the message."""
    first = rejected.limit(1).collect()
    if first:
        raise BadRecords(f"{first[0]['reason']}: {first[0].asDict()}")


def load_examples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Examples from ``.jsonl`` or ``.csv``; blank lines are skipped by both readers."""
    if path.endswith(".jsonl"):
        return _split(_read_json(spark, path, EXAMPLE_SCHEMA), EXAMPLE_FIELDS)
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
        for name in EXAMPLE_FIELDS:
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast("string"))
        rows = rows.select(*EXAMPLE_FIELDS, F.lit(None).cast("map<string,string>").alias("meta"))
        return _split(rows, EXAMPLE_FIELDS)
    raise ValueError(f"{path!r} is neither .jsonl nor .csv")


def save_examples(df: DataFrame, path: str) -> None:
    if path.endswith(".jsonl"):
        df.write.mode("overwrite").json(path)
    elif path.endswith(".csv"):
        df.drop("meta").select(*EXAMPLE_FIELDS).write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        raise ValueError(f"{path!r} is neither .jsonl nor .csv")


def load_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Prediction pairs; a file without any row is an error."""
    raw = _read_json(spark, path, PREDICTION_SCHEMA)
    if raw.isEmpty():
        raise BadRecords(f"{path} holds no predictions")
    return _split(raw, PREDICTION_FIELDS, blank_counts=False)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE_SCHEMA).json(path)


def save_cases(df: DataFrame, path: str) -> None:
    """One JSON object per line; absent reference sequences are left out."""
    df.write.mode("overwrite").json(path)


def load_series(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Daily-series CSV files with ``date`` and ``value`` (names trimmed, any case).

    The series name is the file stem. Returns the usable rows
    (series_id, ds, y) and one reject row per series with duplicate dates or
    with a daily span under 60 days.
    """
    raw = spark.read.csv(path, header=True)
    names = {c.strip().lower(): c for c in raw.columns}
    absent = {"date", "value"} - set(names)
    if absent:
        raise ValueError(f"a daily series needs a date and a value; missing: {sorted(absent)}")
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = raw.select(
        stem.alias("series_id"),
        F.to_date(F.col(f"`{names['date']}`")).alias("ds"),
        F.col(f"`{names['value']}`").cast("double").alias("y"),
    )
    per_day = rows.groupBy("series_id", "ds").agg(F.count(F.lit(1)).alias("n"))
    checks = per_day.groupBy("series_id").agg(
        F.sum((F.col("n") > 1).cast("int")).alias("duplicate_days"),
        (F.datediff(F.max("ds"), F.min("ds")) + 1).alias("span_days"),
    )
    rejected = checks.select(
        "series_id",
        F.when(F.col("duplicate_days") > 0, F.lit("duplicate dates"))
        .when(F.col("span_days") < fixed.MIN_SERIES_DAYS, F.lit("fewer than 60 daily observations"))
        .alias("reason"),
    ).where(F.col("reason").isNotNull())
    return rows.join(rejected.select("series_id"), "series_id", "left_anti"), rejected
