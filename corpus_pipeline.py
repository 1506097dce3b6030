"""A training-corpus pipeline over ``documents``.

Every stage reads what its predecessor kept, applies one corpus operator to all
of it and returns a DataFrame; ``run`` writes each result as Parquet to the
shared folder and reads it back for the next stage. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brightloom.llm import bpe, exact_dedup, jaccard, mixing, quality
from brightloom.llm.common import stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels that are not held out."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for A-Z case) the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word Jaccard similarity of 0.8 or more the one with the smallest doc_id."""
    return jaccard.keep_one(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources meet their target weights."""
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each whole text, checked against their decoding: doc_id, source, n_tokens, ids, round_trip."""
    vocabulary = bpe.public_vocabulary("byte_bpe_50k.json")
    texts = docs.select("doc_id", "source", "text")
    decoded = bpe.decode(bpe.encode(texts, vocabulary), vocabulary)
    return decoded.select(
        "doc_id", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: SQL can express neither the classifier nor the encoder; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
