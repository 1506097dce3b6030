"""Spread a narrowly partitioned input over the cores before CPU-heavy row work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when the input has fewer partitions than the cluster has cores.

    One small file is one task; tokenising or scoring its texts would use one
    core. A large input has partitions enough and passes through untouched, so
    nothing is shuffled where it would cost.
    """
    if df.isStreaming:
        return df
    execution = df._jdf.queryExecution()
    # An adaptive plan has a shuffle of its own, and asking it for partitions would run it.
    if execution.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if execution.toRdd().getNumPartitions() >= cores else df.repartition(cores)
