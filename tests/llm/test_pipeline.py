"""Each stage of the pipeline on its own input, against plain versions where one exists."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from brightloom.llm import bpe, mixing, quality
from brightloom.llm.common import stored


@pytest.fixture(scope="module")
def stages(spark):
    """[(name, input, output)] over the sf0.01 documents."""
    folder, out = "/root/testdata/sf0.01", []
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, folder), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_names_and_columns(spark, stages):
    assert [n for n, _, _ in stages] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "mixing", "bpe"]
    assert all(after.columns == before.columns for _, before, after in stages[:-1])
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_keeps_good_documents(spark, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = before.join(after.select("doc_id", F.lit(1).alias("k")), "doc_id", "left").join(labels, "doc_id")
    share = {r.quality: r.share for r in kept.groupBy("quality").agg(F.avg(F.coalesce("k", F.lit(0))).alias("share")).collect()}
    assert share[1] > 0.97 and share[0] < 0.1


def test_exact_copies(spark, stages):
    _, before, after = stages[1]
    last = {}
    for r in before.collect():
        last[brute.lowered(r.text)] = max(r.doc_id, last.get(brute.lowered(r.text), r.doc_id))
    assert sorted(r.doc_id for r in after.collect()) == sorted(last.values())


def test_near_copies(spark, stages):
    _, before, after = stages[2]
    found = brute.jaccard_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c in found.values()})


def test_mixing(spark, stages):
    _, before, after = stages[3]
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(before).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == copies


def test_encoding(spark, stages):
    _, before, after = stages[4]
    public = Tokenizer.from_file(bpe.public_vocabulary("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows:
        assert r.round_trip and r.n_tokens == len(r.ids) // 4
        assert np.frombuffer(r.ids, "<u4").tolist() == public.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_stages_take_empty_and_odd_tables(spark):
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0), (3, "A text of six plain words.", "en", "a", 26)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "/root/testdata/sf0.001").collect()


def test_rejected_documents_go(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels))
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in scored.collect() if r.score >= quality.THRESHOLD}
