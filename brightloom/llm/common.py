"""Shared pieces of the corpus operators: word counts, chosen columns, and tables kept in the shared folder."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brightloom.session import materialised, scratch_path

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder named by ``spark.checkpoint.dir``, which all executors see."""
    return scratch_path(spark, label)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It is computed once, survives lost executors, and its real size is known to
    the planner: a join with it is broadcast only below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffled beyond.
    """
    return materialised(df, label)


class Workspace:
    """A run's own folder in the shared folder; leaving the ``with`` block drops it with all its tables, on failure too.

    What a run returns must not read from it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self._number = spark, fresh_path(spark, label), count()

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.folder}/{next(self._number)}-{label}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns and no others: ``picked(df, doc_id="id", text="body")`` has doc_id and text.

    A name finds the column spelled exactly so, else the first that differs by
    case only; columns whose names clash with it do no harm.
    """
    names, lower = df.columns, [c.lower() for c in df.columns]
    at = {to: names.index(c) if c in names else lower.index(c.lower()) for to, c in columns.items()}
    return numbered(df).select(*[F.col(f"_{i}").alias(to) for to, i in at.items()])


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns _0, _1, ...: no two names clash."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def most_frequent(counts: DataFrame, limit: int, n: str = "n") -> DataFrame:
    """Rows of ``counts`` with the largest ``n``: as many whole levels as hold at most ``limit`` rows.

    A level spans an eighth of a power of two, so only some hundred totals reach
    the driver, equal counts stay together, and no task ranks all rows.
    """
    level = F.floor(F.log2(F.col(n)) * 8).cast("int")
    held = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True)
    lowest, total = held[0]["level"] + 1 if held else 0, 0
    for row in held:
        total += row["rows"]
        if total > limit:
            break
        lowest = row["level"]
    return counts.where(level >= lowest)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
