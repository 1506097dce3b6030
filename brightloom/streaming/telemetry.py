"""Serving counters and histograms per tumbling window, as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from brightloom.operators.telemetry import bucket_index


def windowed_histogram(
    events: DataFrame, ts: str, key: str, value: str, edges: Sequence[float], width: str = "1 hour",
    lateness: str = "10 minutes",
) -> DataFrame:
    """(window_start, key, le, observations) per closed window; run it in append mode.

    ``le`` holds the upper edge of the bucket a value falls in (not
    cumulative); rows later than the watermark are dropped. State is one
    counter per open window, key and bucket. Works on a batch input too.
    """
    labels = F.array(*[F.lit(str(float(e))) for e in edges], F.lit("+Inf"))
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("_ts", lateness)
    counted = stamped.groupBy(
        F.window("_ts", width).alias("w"), F.col(key), bucket_index(F.col(value), edges).alias("_b")
    ).agg(F.count(F.lit(1)).alias("observations"))
    return counted.select(F.col("w.start").alias("window_start"), key, F.element_at(labels, F.col("_b") + 1).alias("le"), "observations")


def request_rate(events: DataFrame, ts: str, *labels: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(window_start, labels…, requests) per closed window."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("_ts", lateness)
    counted = stamped.groupBy(F.window("_ts", width).alias("w"), *labels).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(F.col("w.start").alias("window_start"), *labels, "requests")
