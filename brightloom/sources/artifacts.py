"""Persisted vector index, audit log and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("event", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("previous_version", T.LongType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("reason", T.StringType()),
    ]
)


def save_index(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, dim: int, vector: str = "vector") -> DataFrame:
    """Reload an index; a stored vector of another dimension is an error."""
    df = spark.read.parquet(path)
    wrong = df.select(F.size(vector).alias("d")).where(F.col("d") != dim).limit(1).collect()
    if wrong:
        raise ValueError(f"index holds vectors of dimension {wrong[0]['d']}, expected {dim}")
    return df


def append_audit(events: DataFrame, path: str) -> None:
    """Append promotion, rejection and rollback events as JSON lines."""
    events.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write an aggregated report; the files stay in the executors' hands."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    else:
        raise ValueError(f"unknown report format {fmt!r}")
