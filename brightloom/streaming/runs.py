"""Run a stream over stored rows to its end and read what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from brightloom.session import scratch_path


def closed_stream(rows: DataFrame, ts: str, days: int = 2) -> DataFrame:
    """``rows`` as a stream, with one more row ``days`` after the last one whose other columns are null.

    That row moves the watermark behind every window of the others, so all of
    them close. The stream reads a copy in the shared folder; it holds all rows
    in files of any order, so run it in as many batches as lateness allows.
    """
    spark, folder = rows.sparkSession, scratch_path(rows.sparkSession, "stream")
    rows.write.parquet(folder)
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != ts]
    last = spark.read.parquet(folder).agg((F.max(ts) + F.expr(f"interval {int(days)} days")).alias(ts))
    last.select(ts, *nulls).select(*rows.columns).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def appended(stream: DataFrame) -> DataFrame:
    """What the stream appends until all its input is read, as a table in the shared folder."""
    spark = stream.sparkSession
    path = scratch_path(spark, "sink")
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None]) -> None:
    """Hand every micro-batch of the stream to ``write`` until all its input is read."""
    query = (
        stream.writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", scratch_path(stream.sparkSession, "stream-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
