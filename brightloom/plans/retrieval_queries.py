"""Registered retrieval and answer queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightloom.functions import fixed, text as tx
from brightloom.operators import answers as an, retrieval as rt
from brightloom.plans.text_queries import SP, search_terms_sql, sentences_sql, snippet_sql, strip_sql, tokens_sql, words_sql
from brightloom.session import scratch_path
from brightloom.sources.tables import table

DIM, K = fixed.EMBEDDING_DIM, 4
DOC_RUBRIC = (
    (r"\n", 3, 3, "Break the text into lines."),
    (r"[.!?]", 5, 2, "Write at least five sentences."),
    (r"[0-9]", 1, 2, "Give figures."),
    (r",", 2, 3, "Use longer sentences."),
)


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _pages(spark, sf):
    p = table(spark, sf, "pages")
    return p.select(
        F.col("page_id").alias("item_id"), "url",
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        tx.html_text(F.regexp_replace("html", r"<title>[^<]*</title>", " ")).alias("body"),
    )


def hashed_embedding(spark, sf):
    return rt.hashed_embedding(_docs(spark, sf), "doc_id", "text").withColumn("weight", F.round("weight", 6))


def normalized_embeddings(spark, sf):
    e = rt.normalized(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    return e.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


def vector_topk(spark, sf):
    """Nearest vectors to each class centre; the centres are averages over the whole table."""
    e = table(spark, sf, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    centres = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select(
        F.col("label").alias("query_id"), F.col("v.x").alias("vector")
    )
    hits = rt.vector_topk(centres, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 10)
    return hits.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def vector_neighbours(spark, sf):
    """Nearest vectors to every twentieth vector, itself among them; the queries grow with the table."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    hits = rt.vector_topk(e.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id"), e, 10)
    return hits.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def bm25_index(spark, sf):
    return rt.bm25_index(_docs(spark, sf), "doc_id", "text").withColumn("idf", F.round("idf", 6))


_PATHS: dict[tuple, str] = {}


def _stored_index(spark, sf, name, build):
    """Path of an index that all queries of one session over the same tables share; the first one builds it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _PATHS:
        path = scratch_path(spark, f"{name}-index")
        build(path)
        _PATHS[key] = path
    return _PATHS[key]


def _index(spark, sf):
    build = lambda path: rt.build_index(_docs(spark, sf), "doc_id", "text", path, rt.hashed_embedder())
    return rt.Index.load(spark, _stored_index(spark, sf, "documents", build), dim=DIM)


def _hits(hits):
    return hits.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def bm25_topk(spark, sf):
    return _hits(rt.bm25_topk(_queries(spark, sf), _index(spark, sf), 10))


def index_append(spark, sf):
    """An index of earlier versions of some documents and of one more, brought up to date by segments, then searched."""
    d, path = table(spark, sf, "documents"), scratch_path(spark, "grown-index")
    earlier = d.where("lang = 'en'").select("doc_id", F.expr("left(text, n_chars div 2)").alias("text"))
    withdrawn = spark.createDataFrame([(-1, "the withdrawn document of the corpus")], "doc_id long, text string")
    rt.build_index(earlier.unionByName(withdrawn), "doc_id", "text", path)
    rt.append(_docs(spark, sf), "doc_id", "text", path)
    index = rt.delete(withdrawn.select(F.col("doc_id").alias("item_id")), path, vectors=False)
    return _hits(rt.bm25_topk(_queries(spark, sf), index, 10))


def rrf_fusion(spark, sf):
    """Fuse two rankings of documents per source: longest text and smallest id."""
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    by_length = rt.top_k(d, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 20)
    by_id = rt.top_k(d, ["source"], [F.asc("doc_id")], 20)
    shape = lambda r: r.select(F.col("source").alias("query_id"), F.col("doc_id").alias("item_id"), "rank")
    out = rt.rrf([shape(by_length), shape(by_id)], [0.7, 0.3])
    return out.select("query_id", "item_id", F.round("score", 9).alias("score"), "rank")


def _hybrid(spark, sf):
    return rt.hybrid(_queries(spark, sf), _index(spark, sf), K)


def hybrid_retrieval(spark, sf):
    return _hybrid(spark, sf).select("query_id", "item_id", F.round("score", 9).alias("score"), "rank")


def _keyword_hits(spark, sf):
    build = lambda path: rt.build_index(_pages(spark, sf), "item_id", rt.keyword_tokens("title", "body"), path)
    path = _stored_index(spark, sf, "pages", build)
    return rt.keyword_search(_queries(spark, sf), rt.Index.load(spark, path, vectors=False).postings, 3)


def keyword_search(spark, sf):
    return _keyword_hits(spark, sf).select("query_id", "item_id", "score", "rank")


def extractive_answers(spark, sf):
    passages = _docs(spark, sf).withColumnRenamed("doc_id", "item_id")
    return an.extractive_answers(_queries(spark, sf), _hybrid(spark, sf), passages)


def context_blocks(spark, sf):
    passages = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "source", "text")
    return an.context_blocks(_queries(spark, sf), _hybrid(spark, sf), passages)


def _questions(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.floor(F.col("item_id") / 4).alias("report_id"),
        (F.col("item_id") % 4).alias("question_no"),
    )


def citation_numbers(spark, sf):
    hits = _keyword_hits(spark, sf).join(_questions(spark, sf), "query_id").join(_pages(spark, sf).select("item_id", "url"), "item_id")
    return an.citation_numbers(hits.select("report_id", "question_no", "rank", "url"))


def reference_list(spark, sf):
    return an.references(citation_numbers(spark, sf), _pages(spark, sf).select("url", "title"))


def batch_findings(spark, sf):
    return an.findings(_questions(spark, sf), _keyword_hits(spark, sf), _pages(spark, sf))


def rubric_score(spark, sf):
    out = an.rubric_score(_docs(spark, sf), "text", DOC_RUBRIC)
    return out.select("doc_id", "score", F.array_join("issues", " ").alias("issues"))


def section_digest(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "html")
    pieces = F.split("html", r"(?=<h[1-6]>)")
    bodies = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda x: tx.html_text(F.regexp_replace(x, r"^<h[1-6]>[^<]*(</h[1-6]>)?", "")))
    return an.section_digest(p, "page_id", bodies)


QUERIES = {
    f.__name__: f
    for f in (
        hashed_embedding, normalized_embeddings, vector_topk, vector_neighbours, bm25_index, bm25_topk, index_append, rrf_fusion, hybrid_retrieval,
        keyword_search, extractive_answers, context_blocks, citation_numbers, reference_list, batch_findings, rubric_score, section_digest,
    )
}

# --- oracles ---------------------------------------------------------------------------


def _sparse_sql(name: str, source: str, row_id: str) -> str:
    return f"""
{name}_c AS (SELECT id, ('0x' || left(md5(t), 8))::BIGINT % {DIM} AS bucket, count(*) AS n
  FROM (SELECT {row_id} AS id, unnest({tokens_sql('text')}) AS t FROM {source}) GROUP BY 1, 2),
{name} AS (SELECT id, bucket, ln(1 + n) / sqrt(sum(ln(1 + n) * ln(1 + n)) OVER (PARTITION BY id)) AS w FROM {name}_c)"""


def _bm25_ctes(pool: int) -> str:
    return f"""
dt AS (SELECT doc_id AS id, {tokens_sql('text')} AS ts FROM documents),
tot AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM dt),
tf AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(ts) AS t FROM dt) GROUP BY 1, 2),
dfr AS (SELECT t, count(*) AS df, ln((SELECT n FROM tot) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY 1),
idf AS (SELECT t, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM dfr) ELSE raw END AS idf FROM dfr),
qt AS (SELECT q, t, count(*) AS qtf FROM (SELECT item_id AS q, unnest({tokens_sql('text')}) AS t FROM benchmark) GROUP BY 1, 2),
bs AS (SELECT q, tf.id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / (SELECT avgdl FROM tot)))), 9) AS s
  FROM qt JOIN idf ON idf.t = qt.t JOIN tf ON tf.t = qt.t JOIN dt ON dt.id = tf.id GROUP BY 1, 2),
br AS (SELECT q, id, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS r FROM bs WHERE s > 0 QUALIFY r <= {pool})"""


_HYBRID = f"""
{_sparse_sql('ds', 'documents', 'doc_id')}, {_sparse_sql('qs', 'benchmark', 'item_id')}, {_bm25_ctes(20)},
vs AS (SELECT qs.id AS q, ds.id, round(sum(ds.w * qs.w), 9) AS s FROM qs JOIN ds ON ds.bucket = qs.bucket GROUP BY 1, 2),
vr AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS r FROM vs QUALIFY r <= 20),
fu AS (SELECT q, id, round(sum(p), 12) AS s FROM (SELECT q, id, 0.5::DOUBLE / (60 + r) AS p FROM vr UNION ALL SELECT q, id, 0.5::DOUBLE / (60 + r) FROM br) GROUP BY 1, 2),
hy AS (SELECT q, id, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, id)::INT AS r FROM fu QUALIFY r <= {K})"""


def _squeeze_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({x}, '{SP}+', ' ', 'g')")


def _html_sql(x: str) -> str:
    return _squeeze_sql(f"regexp_replace({x}, '<script.*?</script>|<style.*?</style>|<[^>]*>', ' ', 'gs')")


def _first_sentence_sql(x: str) -> str:
    marked = rf"regexp_replace({strip_sql(x)}, '(\.){SP}+', '\1' || chr(1))"
    return f"rtrim(string_split({marked}, chr(1))[1], '.') || '.'"


_PAGES = f"""
pg AS (SELECT page_id AS id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  {_html_sql("regexp_replace(html, '<title>[^<]*</title>', ' ', 'g')")} AS body FROM pages),
pt AS (SELECT id, t, sum(w) AS w FROM (
  SELECT id, unnest({search_terms_sql('title')}) AS t, 2.0::DOUBLE AS w FROM pg UNION ALL
  SELECT id, unnest({search_terms_sql('body')}), 1.0 FROM pg) GROUP BY 1, 2),
kq AS (SELECT DISTINCT item_id AS q, unnest({search_terms_sql('text')}) AS t FROM benchmark),
kr AS (SELECT q, id, sum(w) AS s, row_number() OVER (PARTITION BY q ORDER BY sum(w) DESC, id)::INT AS r
  FROM kq JOIN pt ON pt.t = kq.t GROUP BY 1, 2 QUALIFY r <= 3)"""
_CITED = _PAGES + """,
ch AS (SELECT q // 4 AS report_id, q % 4 AS question_no, r, url, kr.q, kr.id FROM kr JOIN pg ON pg.id = kr.id),
cf AS (SELECT report_id, url, min((question_no, r)) AS f FROM ch GROUP BY 1, 2),
cn AS (SELECT report_id, url, row_number() OVER (PARTITION BY report_id ORDER BY f)::INT AS citation FROM cf)"""


def _rubric_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    fails = [(f"len(regexp_extract_all(text, '{p}')) < {h}", w, i) for p, h, w, i in DOC_RUBRIC]
    fails.append((f"length(text) < {fixed.REPORT_MIN_CHARS}", fixed.REPORT_BRIEF_WEIGHT, fixed.REPORT_BRIEF_ISSUE))
    lost = " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w, _ in fails)
    issues = ", ".join(f"CASE WHEN {c} THEN {q(i)} END" for c, _, i in fails)
    return f"SELECT doc_id, greatest(0, 10 - ({lost})) AS score, array_to_string(list_filter([{issues}], lambda x: x IS NOT NULL), ' ') AS issues FROM documents"


ORACLES = {
    "hashed_embedding": f"WITH {_sparse_sql('ds', 'documents', 'doc_id')} SELECT id AS doc_id, bucket::INT AS bucket, round(w, 6) AS weight FROM ds",
    "normalized_embeddings": """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM embeddings)
SELECT vec_id, (i - 1)::INT AS pos, round(CASE WHEN l > 0 THEN v[i] / l ELSE v[i] END, 6) AS x FROM n, unnest(range(1, len(v) + 1)) AS u(i)""",
    "vector_topk": """WITH p AS (SELECT label, i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) AS u(i)),
m AS (SELECT label, i, round(avg(x), 9) AS x FROM p GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY 1),
s AS (SELECT c.label AS query_id, vec_id AS item_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 9) AS s FROM c, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id)::INT AS rank FROM s)
SELECT query_id::BIGINT AS query_id, item_id, round(s, 6) AS score, rank FROM r WHERE rank <= 10""",
    "vector_neighbours": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id,
  round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id)::INT AS rank FROM s)
SELECT query_id::BIGINT AS query_id, item_id, round(s, 6) AS score, rank FROM r WHERE rank <= 10""",
    "bm25_index": f"WITH {_bm25_ctes(10)} SELECT t AS term, df, round(idf, 6) AS idf FROM idf",
    "index_append": f"WITH {_bm25_ctes(10)} SELECT q AS query_id, id AS item_id, round(s, 6) AS score, r::INT AS rank FROM br",
    "bm25_topk": f"WITH {_bm25_ctes(10)} SELECT q AS query_id, id AS item_id, round(s, 6) AS score, r::INT AS rank FROM br",
    "rrf_fusion": """WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 20),
b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents QUALIFY r <= 20),
f AS (SELECT source, doc_id, round(sum(p), 12) AS s FROM (SELECT source, doc_id, 0.7::DOUBLE / (60 + r) AS p FROM a UNION ALL SELECT source, doc_id, 0.3::DOUBLE / (60 + r) FROM b) GROUP BY 1, 2)
SELECT source AS query_id, doc_id AS item_id, round(s, 9) AS score, row_number() OVER (PARTITION BY source ORDER BY s DESC, doc_id)::INT AS rank FROM f""",
    "hybrid_retrieval": f"WITH {_HYBRID} SELECT q AS query_id, id AS item_id, round(s, 9) AS score, r AS rank FROM hy",
    "keyword_search": f"WITH {_PAGES} SELECT q AS query_id, id AS item_id, s AS score, r AS rank FROM kr",
    "extractive_answers": f"""WITH {_HYBRID},
ctx AS (SELECT hy.q, hy.r, d.text, list_filter({tokens_sql('b.text')}, lambda t: NOT list_contains({words_sql(fixed.ANSWER_STOP_WORDS)}, t)) AS terms
  FROM hy JOIN documents d ON d.doc_id = hy.id JOIN benchmark b ON b.item_id = hy.q),
sn AS (SELECT q, r, text, terms, list_transform({sentences_sql('text')}, lambda s: {_squeeze_sql('s')}) AS ss FROM ctx),
sc AS (SELECT q, r, i, ss[i] AS s, len(list_intersect(list_distinct(terms), list_distinct({tokens_sql('ss[i]')}))) AS h
  FROM sn, unnest(range(1, len(ss) + 1)) AS u(i)),
tp AS (SELECT *, row_number() OVER (PARTITION BY q, r ORDER BY h DESC, i) AS o FROM sc),
pk AS (SELECT q, r, string_agg(s, ' ' ORDER BY i) AS best FROM tp WHERE o <= 2 AND h > 0 GROUP BY 1, 2),
pc AS (SELECT sn.q, sn.r, CASE WHEN len(ss) = 0 THEN {strip_sql('text')} ELSE coalesce(best, ss[1]) END || ' [' || sn.r || ']' AS piece
  FROM sn LEFT JOIN pk ON pk.q = sn.q AND pk.r = sn.r),
aw AS (SELECT q, string_agg(piece, chr(10) ORDER BY r) AS answer FROM pc GROUP BY 1)
SELECT item_id AS query_id, coalesce(answer, '{fixed.NO_CONTEXT_ANSWER}') AS answer FROM benchmark LEFT JOIN aw ON q = item_id""",
    "context_blocks": f"""WITH {_HYBRID}, c AS (SELECT q, string_agg('[' || r || '] (source: ' || source || ') ' || text, chr(10) || chr(10) ORDER BY r) AS c
  FROM hy JOIN documents d ON d.doc_id = hy.id GROUP BY 1)
SELECT item_id AS query_id, coalesce(c, '{fixed.NO_SOURCES}') AS context FROM benchmark LEFT JOIN c ON q = item_id""",
    "citation_numbers": f"WITH {_CITED} SELECT report_id, url, citation FROM cn",
    "reference_list": f"""WITH {_CITED} SELECT report_id, citation, '[' || citation || '] ' || title || ' - ' || cn.url AS line
FROM cn JOIN pg ON pg.url = cn.url""",
    "batch_findings": f"""WITH {_CITED}, sn AS (SELECT id, {snippet_sql('body')} AS snip FROM pg),
a AS (SELECT ch.q, string_agg(rtrim({_first_sentence_sql('snip')}, '.') || ' [' || citation || '].', ' ' ORDER BY ch.r) AS answer
  FROM ch JOIN cn ON cn.report_id = ch.report_id AND cn.url = ch.url JOIN sn ON sn.id = ch.id WHERE snip <> '' GROUP BY 1)
SELECT item_id AS query_id, item_id // 4 AS report_id, item_id % 4 AS question_no, coalesce(answer, '{fixed.NO_ANSWER}') AS answer
FROM benchmark LEFT JOIN a ON a.q = item_id""",
    "rubric_score": _rubric_sql(),
    "section_digest": rf"""WITH p AS (SELECT page_id, string_split(regexp_replace(html, '(<h[1-6]>)', chr(1) || '\1', 'g'), chr(1))[2:] AS s FROM pages),
b AS (SELECT page_id, list_filter(list_transform(s, lambda x: {_html_sql("regexp_replace(x, '^<h[1-6]>[^<]*(</h[1-6]>)?', '')")}), lambda x: x <> '') AS b FROM p)
SELECT page_id, CASE WHEN len(b) > 0 THEN array_to_string(list_transform(b, lambda x: '- ' || {_first_sentence_sql('x')}), chr(10)) ELSE '{fixed.NO_FINDINGS}' END AS digest FROM b""",
}
