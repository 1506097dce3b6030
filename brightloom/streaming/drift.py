"""Drift verdicts per arriving window against a frozen reference profile.

The stream keeps only bin counts per open window. A closed window leaves the
stream whole, in one micro-batch; ``foreachBatch`` turns its counts into PSI
and overwrites that window's partition, so a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from brightloom.functions import fixed
from brightloom.operators import drift as dr
from brightloom.session import materialised


def frozen_profile(reference: DataFrame, columns: Sequence[str], bins: int = fixed.PSI_BINS) -> DataFrame:
    """(feature, edges, shares): floored reference share of every bin, one row per feature."""
    values = dr.feature_values(reference, columns)
    return dr.reference_profile(values, materialised(dr.bin_edges(values, bins), "bin-edges"))


def windowed_bins(
    rows: DataFrame, ts: str, columns: Sequence[str], profile: DataFrame, width: str, lateness: str = "10 minutes"
) -> DataFrame:
    """(window_start, feature, bin, n) per closed window. The profile has one row per feature."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    stamped = rows.withColumn("_ts", F.col(ts).cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("_ts", lateness)
    long = stamped.select("_ts", F.explode(F.array(*cells)).alias("c")).select("_ts", "c.feature", "c.value")
    placed = long.where(F.col("value").isNotNull()).join(F.broadcast(profile.select("feature", "edges")), "feature")
    counted = placed.groupBy(
        F.window("_ts", width).alias("w"), "feature", dr.bin_of(F.col("value"), F.col("edges")).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "feature", "bin", "n")


def window_verdicts(bins: DataFrame, profile: DataFrame) -> DataFrame:
    """(window_start, feature, psi, severity) from bin counts."""
    found = dr.psi_of_bins(bins, profile, "window_start")
    return found.select("window_start", "feature", "psi", dr.severity(F.col("psi")).alias("severity"))


def write_verdicts(profile: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: verdicts as Parquet partitioned by window, replaced as a whole."""

    def write(batch: DataFrame, batch_id: int) -> None:
        day = F.date_format("window_start", "yyyy-MM-dd-HH-mm").alias("window_id")
        (
            window_verdicts(batch, profile).select("*", day).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("window_id").parquet(path)
        )

    return write
