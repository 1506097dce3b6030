"""Session defaults used by the tests, the bench and scripts.

Library code never creates a session; every function takes DataFrames or the
caller's session.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "brightloom", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests, the bench and scripts; on a cluster its folders come from the cluster's own settings."""
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BRIGHTLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        .config("spark.checkpoint.dir", os.path.join(scratch, "checkpoints"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """The folder that all executors see: the argument, or the setting ``spark.checkpoint.dir``.

    Without either a local session, whose only executor is the driver, gets a
    folder of its own; on a cluster that is an error.
    """
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("no shared folder: set spark.checkpoint.dir or name one")
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str, folder: str | None = None) -> str:
    """A fresh path in the shared folder for a table that outlives its lineage."""
    return f"{shared_folder(spark, folder)}/{label}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, and its size is known to the planner."""
    path = scratch_path(df.sparkSession, label, folder)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever Spark can write; nothing happens if there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def checkpoint(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Cut the lineage through the shared folder. Nothing is written to a folder that only the driver sees."""
    folder = shared_folder(df.sparkSession, folder)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()
