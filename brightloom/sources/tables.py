"""Relational source: a folder of Parquet tables, read-only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Expose the folder's tables as temporary views for SQL."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """Same table from a database; pass ``partitionColumn`` and its bounds to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
