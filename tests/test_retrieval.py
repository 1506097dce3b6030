import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightloom.functions import matching, text as tx
from brightloom.functions.matching import stacked
from brightloom.operators import answers as an, retrieval as rt

TEXTS = ["the cat sat on the mat", "a dog and a cat", "birds fly over the sea", "the cat the cat", "", "sea and sand", "a dog and a cat"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(0, "cat cat dog"), (1, "sea birds"), (2, "zebra")], "query_id long, text string")


def brute_bm25(query):
    docs = [t.split() for t in TEXTS]
    df = Counter(w for d in docs for w in set(d))
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
    avg = sum(map(len, docs)) / len(docs)
    scores = [
        sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query.split()) for d in docs
    ]
    return [(i, s) for i, s in sorted(enumerate(scores), key=lambda p: (-round(p[1], 9), p[0])) if s > 1e-12]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    rt.build_index(corpus, "doc_id", "text", path, rt.hashed_embedder(64))
    return rt.Index.load(spark, path)


def test_bm25(index, queries):
    hits = rt.bm25_topk(queries, index, 5).orderBy("query_id", "rank").collect()
    for q, text in ((0, "cat cat dog"), (1, "sea birds"), (2, "zebra")):
        got = [(r["item_id"], r["score"]) for r in hits if r["query_id"] == q]
        want = brute_bm25(text)[:5]
        assert [i for i, _ in got] == [i for i, _ in want]
        assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-8)


def ranked(hits):
    return [(r["query_id"], r["rank"], r["item_id"], round(r["score"], 9)) for r in hits.orderBy("query_id", "rank").collect()]


def test_a_grown_index_equals_a_rebuilt_one(spark, corpus, queries, index, tmp_path):
    path, embedder = str(tmp_path / "grown"), rt.hashed_embedder(64)
    first = spark.createDataFrame([(0, "an older text of the cat"), (1, TEXTS[1]), (3, ""), (90, "a cat to delete"), (91, "")], "doc_id long, text string")
    rt.build_index(first, "doc_id", "text", path, embedder)
    rt.append(corpus.where("doc_id in (0, 2, 3)"), "doc_id", "text", path, embedder)
    rt.delete(spark.createDataFrame([(90,), (91,), (777,)], "item_id long"), path)
    grown = rt.append(corpus.where("doc_id in (4, 5, 6)"), "doc_id", "text", path, embedder)
    for a, b in ((grown, index), (rt.Index.load(spark, path, dim=64), index)):
        assert ranked(rt.bm25_topk(queries, a, 5)) == ranked(rt.bm25_topk(queries, b, 5))
        assert ranked(rt.hybrid(queries, a, 4, embedder=embedder)) == ranked(rt.hybrid(queries, b, 4, embedder=embedder))
        assert sorted(a.terms.select("term", "df").collect()) == sorted(b.terms.select("term", "df").collect())
        assert a.totals.collect() == b.totals.collect()
    assert rt.build_index(first, "doc_id", "text", path).vectors is None  # a rebuild leaves nothing behind
    assert sorted(r["item_id"] for r in rt.Index.load(spark, path, vectors=False).postings.select("item_id").distinct().collect()) == [0, 1, 90]


def test_other_dimensions_are_refused(spark, corpus, tmp_path):
    path = str(tmp_path / "dims")
    rt.build_index(corpus, "doc_id", "text", path, rt.hashed_embedder(64))
    with pytest.raises(ValueError, match=r"dimension \[64\], expected 32"):
        rt.Index.load(spark, path, dim=32)
    with pytest.raises(ValueError, match="expected 32"):
        rt.append(corpus, "doc_id", "text", path, rt.hashed_embedder(32))
    with pytest.raises(ValueError, match="grows with its embedder"):
        rt.append(corpus, "doc_id", "text", path)
    dense = rt.Embedder(lambda df, i, t: df.select(i, F.sequence(F.lit(1), F.length(t) % 3 + 1).cast("array<double>").alias("vector")), stacked)
    with pytest.raises(ValueError, match="in one corpus"):
        rt.build_index(corpus, "doc_id", "text", str(tmp_path / "ragged"), dense)


def test_a_stored_keyword_index(spark, tmp_path):
    pages = spark.createDataFrame([(1, "Cats", "cats and dogs"), (2, "Dogs", "a dog")], "id long, t string, b string")
    stored = rt.build_index(pages, "id", rt.keyword_tokens("t", "b"), str(tmp_path / "k"))
    q = spark.createDataFrame([(0, "dog cats")], "query_id long, text string")
    assert ranked(rt.keyword_search(q, stored.postings, 5)) == ranked(rt.keyword_search(q, rt.keyword_postings(pages, "id", "t", "b"), 5))


def test_searches_move_no_row_per_query_and_item(spark, index, queries):
    for hits in (rt.bm25_topk(queries, index, 5), rt.keyword_search(queries, index.postings, 5)):
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(query_id" in plan and not re.search(r"hashpartitioning\(query_id[^)]*item_id", plan)


@pytest.mark.parametrize("items, asked, pairs", [(512, 256, 1 << 20), (3, 2, 5)])
def test_term_search_in_blocks(spark, items, asked, pairs, monkeypatch):
    monkeypatch.setattr(rt, "TERM_ROWS", items)
    monkeypatch.setattr(rt, "QUERY_ROWS", asked)
    rng, words = np.random.default_rng(3), [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(words, n))
    pages, wanted = [(f"p{i:03d}", "", text(i % 7)) for i in range(90)], [(i, text(i % 5)) for i in range(11)]
    q = spark.createDataFrame(wanted, "query_id int, text string")
    postings = rt.keyword_postings(spark.createDataFrame(pages, "id string, t string, b string"), "id", "t", "b")
    got = [(r.query_id, r.rank, r.item_id, r.score) for r in rt.keyword_search(q, postings, 6).orderBy("query_id", "rank").collect()]
    want = []
    for i, asks in wanted:
        scores = [(-sum(b.split().count(w) for w in set(asks.split())), p) for p, _, b in pages]
        want += [(i, n, p, float(-s)) for n, (s, p) in enumerate(sorted(x for x in scores if x[0] < 0)[:6], 1)]
    assert got == want and len(got) > 40
    sizes, codes, values = np.array([3, 0, 4, 2]), rng.integers(0, 12, 9), rng.random(9)
    who, wants, weights = np.array([0, 0, 1, 2, 2]), rng.integers(0, 12, 5), rng.random(5)
    monkeypatch.setattr(matching, "EXPANDED", pairs)
    named = lambda c: pa.array([words[i] for i in c])
    scores = matching.term_scores(sizes, named(codes), values, who, named(wants), weights, 3)
    plain = np.zeros((4, 3))
    for item, c, v in zip(np.repeat(np.arange(4), sizes), codes, values):
        for w, c2, x in zip(who, wants, weights):
            plain[item, w] += v * x * (c == c2)
    assert scores == pytest.approx(plain)


@pytest.mark.parametrize("rows", [2000, 13])
def test_vector_search_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(rt, "QUERY_ROWS", rows)
    monkeypatch.setattr(rt, "ITEM_ROWS", rows)
    rng = np.random.default_rng(0)
    items, asked = rng.normal(size=(230, 8)), rng.normal(size=(60, 8))
    items[7] = items[3]
    items[9] = 0
    frame = lambda m, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} long, vector array<double>")
    hits = rt.vector_topk(frame(asked, "query_id"), frame(items, "item_id"), 4).collect()
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    scores = np.round(unit(asked) @ unit(items).T, 9)
    for q in range(60):
        want = sorted(range(230), key=lambda i: (-scores[q, i], i))[:4]
        got = sorted((r["rank"], r["item_id"]) for r in hits if r["query_id"] == q)
        assert [i for _, i in got] == want


def test_no_queries(index, queries):
    none = queries.where("query_id > 99")
    assert rt.hybrid(none, index, 3, embedder=rt.hashed_embedder(64)).count() == 0


def test_another_embedder(spark, corpus, queries, tmp_path):
    """Vectors of two numbers: length of the text and one."""
    two = lambda df, row_id, text: df.select(row_id, F.array(F.length(text).cast("double"), F.lit(1.0)).alias("vector"))
    own = rt.Embedder(two, stacked)
    built = rt.build_index(corpus, "doc_id", "text", str(tmp_path), own)
    hits = rt.hybrid(queries, built, 3, weight=1.0, embedder=own).where("query_id = 2").orderBy("rank").collect()
    lengths = [len(t) for t in TEXTS]
    angle = lambda n: math.atan2(1, n)
    want = sorted(range(len(TEXTS)), key=lambda i: (-round(math.cos(angle(lengths[i]) - angle(5)), 9), i))[:3]
    assert [r.item_id for r in hits] == want


def test_an_index_without_vectors_refuses_hybrid(corpus, queries, tmp_path):
    with pytest.raises(ValueError):
        rt.hybrid(queries, rt.build_index(corpus, "doc_id", "text", str(tmp_path)), 3)


def test_tokens_are_counted_on_their_row(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],), (None,)], "t array<string>")
    got = [[tuple(x) for x in r.c] for r in df.select(tx.counted(F.col("t")).alias("c")).collect()]
    assert got == [[("a", 1), ("b", 3), ("c", 1)], [], []]
    plan = df.select(tx.counted(F.col("t")).alias("c"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_zero_vectors_can_be_hits(corpus, queries):
    vec = lambda d, c: rt.term_buckets(d.withColumnRenamed(c, "item_id"), "item_id", "text", 64)
    from brightloom.functions.matching import bucket_counts

    q = vec(queries, "query_id").withColumnRenamed("item_id", "query_id")
    hits = rt.vector_topk(q, vec(corpus, "doc_id"), 7, bucket_counts(64))
    assert hits.count() == 21 and hits.where("score = 0").count() > 0


def test_hashed_embedding_is_unit(corpus):
    rows = rt.hashed_embedding(corpus, "doc_id", "text", 64).groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert len(rows) == 6 and all(r["n"] == pytest.approx(1) for r in rows)


def ranking(spark, pairs):
    return spark.createDataFrame([(0, i, r) for r, i in enumerate(pairs, 1)], "query_id long, item_id long, rank int")


def test_rrf(spark):
    a, b = ranking(spark, [5, 3, 9]), ranking(spark, [3, 7])
    order = lambda wa, wb: [r["item_id"] for r in rt.rrf([a, b], [wa, wb]).where("score > 0").orderBy("rank").collect()]
    assert order(1.0, 0.0) == [5, 3, 9] and order(0.0, 1.0) == [3, 7]
    assert order(0.5, 0.5)[0] == 3
    with pytest.raises(ValueError):
        rt.rrf([a, b], [1.0])


def test_keyword_search(spark):
    pages = spark.createDataFrame([(1, "Cats", "dogs and cats"), (2, "x", "cat cat cat"), (3, "Dog", "none")], "id long, t string, b string")
    q = spark.createDataFrame([(0, "the cats cats"), (1, "dog")], "query_id long, text string")
    got = [(r["query_id"], r["item_id"], r["score"]) for r in rt.keyword_search(q, rt.keyword_postings(pages, "id", "t", "b"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3.0), (0, 2, 3.0), (1, 3, 2.0), (1, 1, 1.0)]


def test_extractive_answer(spark):
    q = spark.createDataFrame([(0, "How does the cat eat fish?"), (1, "nothing")], "query_id long, text string")
    p = spark.createDataFrame([(1, "Dogs bark. A cat eats. The cat will eat fish. Fish swim."), (2, "Plain  text\nonly")], "item_id long, text string")
    hits = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id long, item_id long, rank int")
    got = {r["query_id"]: r["answer"] for r in an.extractive_answers(q, hits, p).collect()}
    assert got[0] == "A cat eats. The cat will eat fish. [1]\nPlain text only [2]"
    assert got[1].startswith("No relevant context")


def test_citations_and_findings(spark):
    questions = spark.createDataFrame([(10, 1, 0), (11, 1, 1), (12, 1, 2)], "query_id long, report_id long, question_no long")
    sources = spark.createDataFrame([(1, "A", "ua", "First. Second."), (2, "B", "ub", "Other one")], "item_id long, title string, url string, body string")
    hits = spark.createDataFrame([(10, 2, 1), (11, 1, 1), (11, 2, 2)], "query_id long, item_id long, rank int")
    got = {r["query_id"]: r["answer"] for r in an.findings(questions, hits, sources).collect()}
    assert got[10] == "Other one [1]." and got[11] == "First [2]. Other one [1]." and got[12].startswith("No relevant sources")
    numbers = spark.createDataFrame([(1, "ua", 2), (1, "ub", 1)], "report_id long, url string, citation int")
    lines = [r["line"] for r in an.references(numbers, sources.select("url", "title")).orderBy("citation").collect()]
    assert lines == ["[1] B - ub", "[2] A - ua"]


def test_rubric(spark):
    full = "## References\n### a\n### b\n[1]\n## Limitations\n" + "x" * 400
    rows = an.rubric_score(spark.createDataFrame([(full,), ("short",)], "t string"), "t").collect()
    assert (rows[0]["score"], rows[0]["issues"]) == (10, []) and rows[1]["score"] == 0 and len(rows[1]["issues"]) == 5


def test_digest(spark):
    df = spark.createDataFrame([(1, "# A\nOne. Two.\n# B\nThree"), (2, "")], "id int, t string")
    bodies = F.transform(tx.sections(F.col("t")), lambda s: s["body"])
    got = {r["id"]: r["digest"] for r in an.section_digest(df, "id", bodies).collect()}
    assert got == {1: "- One.\n- Three.", 2: "- No findings were available."}


def test_the_registered_search_asks_for_every_twentieth_vector(spark, small):
    from brightloom.plans.retrieval_queries import QUERIES

    asked = spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert QUERIES["vector_neighbours"](spark, small).count() == 10 * asked > 0
