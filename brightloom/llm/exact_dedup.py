"""Exact deduplication as a stateful stream.

Each text is reduced to a narrow key row: SHA-256 of the normalised text, the
document's id and where its content lies (file and row). A streaming
aggregation without watermark keeps one entry per digest in a disk-backed
(RocksDB) state store and never expires it; copies are combined on the map side,
so one text that fills a third of the corpus costs one state row per task. New
files continue from the same state. Digests that hit are then checked on the
full bytes; texts that only share a digest are told apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brightloom.llm.common import ascii_lower, fresh_path, stored, unused

#: Disk-backed state; no disk is set aside in advance, as a state has many small stores, and all stores of an executor share
#: one bounded memory.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


def sha256(normalised: Column) -> Column:
    return F.unhex(F.sha2(normalised.cast("binary"), 256))


def _is_scan(docs: DataFrame) -> bool:
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return False
    return True


def located(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a content locator (file, row) per row; frames that are no plain file scan are written first."""
    if not _is_scan(docs):
        docs = stored(docs, "documents")
    return docs.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


class DigestState:
    """The keyed state: digest -> number of rows, largest (doc_id, locator). It lives in ``folder`` and outlasts sessions."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def absorb(self, keys_path: str) -> None:
        """Stream every key file not seen before into the state; returns when all are in."""
        conf = self.spark.conf
        before = {key: conf.get(key, None) for key in _STATE}
        for key, value in _STATE.items():
            conf.set(key, value)
        try:
            keys = self.spark.readStream.schema(self.spark.read.parquet(keys_path).schema).parquet(keys_path)
            held = keys.groupBy("digest").agg(
                F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "locator")).alias("kept")
            )
            query = (
                held.writeStream.outputMode("update").format("noop").trigger(availableNow=True)
                .option("checkpointLocation", self.folder).start()
            )
            query.awaitTermination()
        finally:
            for key, value in before.items():
                if value is None:
                    conf.unset(key)
                else:
                    conf.set(key, value)

    def entries(self) -> DataFrame:
        """digest, group_size, keep_id, kept_at: the state as of its last batch."""
        rows = self.spark.read.format("statestore").load(self.folder)
        count, kept = (F.col("value")[f.name] for f in rows.schema["value"].dataType.fields)
        return rows.select(
            F.col("key.digest").alias("digest"), count.alias("group_size"), kept["doc_id"].alias("keep_id"),
            kept["locator"].alias("kept_at"),
        )


def classify(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest: Callable[[Column], Column] = sha256,
    state_folder: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, locator, group_size, keep_id, kept.

    Equal means identical after lower-casing A-Z; null counts as empty, and all
    empty texts are one group. The row with the largest id stays (null ids are
    smallest); of repeated rows with that id the one that lies last stays.
    Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    place = unused(docs, "_locator")
    normalised = located(docs, place).select(
        F.col(f"`{doc_id}`").alias("doc_id"), ascii_lower(F.col(f"`{text}`")).alias("text"), F.col(place).alias("locator")
    ).withColumn("digest", digest(F.col("text")))
    keys_path = fresh_path(spark, "digests")
    normalised.select("digest", "doc_id", "locator").write.parquet(keys_path)
    keys = spark.read.parquet(keys_path)

    state = DigestState(spark, state_folder or fresh_path(spark, "digest-state"))
    if not keys.isEmpty():
        state.absorb(keys_path)
        entries = state.entries()
    else:
        entries = keys.select(
            "digest", F.lit(0).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"), F.col("locator").alias("kept_at")
        )
    members = keys.join(entries, "digest")

    # Full bytes: rows of a digest fall together as long as their texts are identical, first within each task.
    texts = normalised.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
    clashing = stored(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "clashes")
    if clashing.isEmpty():
        return _shaped(members)
    apart = normalised.join(clashing, "digest", "left_semi")
    exact = apart.groupBy("digest", "text").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "locator")).alias("top")
    ).select("digest", "text", "group_size", F.col("top.doc_id").alias("keep_id"), F.col("top.locator").alias("kept_at"))
    split = apart.join(exact, ["digest", "text"]).drop("text")
    return _shaped(members.join(clashing, "digest", "left_anti").unionByName(split))


def _shaped(members: DataFrame) -> DataFrame:
    return members.select(
        "doc_id", "digest", "locator", "group_size", "keep_id", (F.col("locator") == F.col("kept_at")).alias("kept")
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, without copies; see :func:`classify` for which row stays."""
    place = unused(docs, "_place")
    if not _is_scan(docs):
        docs = stored(docs, "documents")
    dropped = classify(docs, text, doc_id).where(~F.col("kept")).select(F.col("locator").alias(place))
    kept = located(docs, place).join(stored(dropped, "copies"), place, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
