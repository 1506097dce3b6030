"""Text, markdown and nested-JSON corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from brightloom.functions import text as tx

CORPUS_SCHEMA = T.StructType(
    [
        T.StructField(
            "documents",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("title", T.StringType()),
                        T.StructField("url", T.StringType()),
                        T.StructField("body", T.StringType()),
                    ]
                )
            ),
        )
    ]
)


def section_rows(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per non-blank heading section: ``keep`` columns, section_no, section, text."""
    return df.select(*keep, F.posexplode(tx.sections(F.col(text))).alias("section_no", "_s")).select(
        *keep, "section_no", F.col("_s.section").alias("section"), F.col("_s.body").alias("text")
    )


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """``.txt`` and ``.md`` files under ``path``, recursive: path, source, section_no, section, text.

    Markdown yields one row per heading section, plain text one row per file;
    blank ones are dropped. A missing path is an analysis error. Order rows by
    ``path, section_no``.
    """
    raw = (
        spark.read.option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    )
    named = raw.withColumn("source", F.element_at(F.split("path", "/"), -1))
    suffix = F.lower(F.regexp_extract("source", r"(\.[^.]+)$", 1))
    plain = named.where(suffix == ".txt").select(
        "path", "source", F.lit(0).alias("section_no"), F.lit(None).cast("string").alias("section"),
        tx.strip(F.col("value")).alias("text"),
    ).where(F.col("text") != "")
    marked = section_rows(named.where(suffix == ".md"), "value", "path", "source")
    return plain.unionByName(marked)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Search corpus from JSON files shaped ``{"documents": [{id, title, url, body}]}``."""
    nested = spark.read.schema(CORPUS_SCHEMA).option("multiLine", "true").json(path)
    return nested.select(F.explode("documents").alias("d")).select("d.*")
