"""Registered text-preparation queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightloom.functions import fixed, text as tx
from brightloom.operators import text_prep as tp
from brightloom.plans.bindings import PAIRS_SQL, conversation_pairs
from brightloom.sources.tables import table

CHUNK_SIZE, CHUNK_OVERLAP, PACK_SIZE = 800, 120, 500


def _docs(spark, sf, *columns):
    return table(spark, sf, "documents").select(*(columns or ("doc_id", "text")))


def section_split(spark, sf):
    """Sections of pages whose heading tags have become markdown heading lines."""
    pages = table(spark, sf, "pages")
    markdown = F.regexp_replace("html", r"<h[1-6]>([^<]*)(</h[1-6]>)?", "\n# $1\n")
    rows = pages.select("page_id", F.posexplode(tx.sections(markdown)).alias("section_no", "s"))
    return rows.select("page_id", "section_no", F.col("s.section").alias("section"), F.col("s.body").alias("body"))


def chunk_fixed(spark, sf):
    return tp.chunk_documents(_docs(spark, sf), "text", "doc_id", strategy="fixed", size=CHUNK_SIZE, overlap=CHUNK_OVERLAP)


def chunk_sentence(spark, sf):
    return tp.chunk_documents(_docs(spark, sf), "text", "doc_id", strategy="sentence", size=PACK_SIZE)


def token_counts(spark, sf):
    return tp.term_counts(_docs(spark, sf), "doc_id", "text")


def tokens_stemmed(spark, sf):
    return tp.counted_terms(_docs(spark, sf), "doc_id", tx.search_terms(F.col("text")))


def pii_scrub(spark, sf):
    return tp.scrub_pii(_docs(spark, sf), "text")


def dedupe_documents(spark, sf):
    return tp.dedupe(_docs(spark, sf), "text", "doc_id").select("doc_id")


def length_filter(spark, sf):
    return tp.length_between(_docs(spark, sf, "doc_id", "source", "text"), ["text"], 40, 4000).select(
        "doc_id", "source", F.length("text").alias("chars")
    )


def cleaning_report(spark, sf):
    pairs = conversation_pairs(spark, sf).select(
        F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("id"),
        "prompt", "reply",
    )
    return tp.cleaning_report(pairs, "id", "prompt", "reply", 40, 1500)


def document_cleaning_report(spark, sf):
    docs = _docs(spark, sf).withColumn("response", F.lit(""))
    return tp.cleaning_report(docs, "doc_id", "text", "response")


def cleaned_documents(spark, sf):
    docs = _docs(spark, sf).withColumn("response", F.lit(""))
    return tp.clean_examples(docs, "doc_id", "text", "response").select("doc_id", F.length("text").alias("chars"))


def stratified_split(spark, sf):
    return tp.stratified_split(_docs(spark, sf, "doc_id", "source"), "source", "doc_id").select("doc_id", "source", "split")


def chat_render(spark, sf):
    pairs = conversation_pairs(spark, sf)
    system = F.coalesce("system", F.lit(fixed.DEFAULT_SYSTEM_PROMPT))
    return pairs.select(
        "conv_id", "turn",
        tp.chat_text("llama3", system, F.col("prompt"), F.col("reply")).alias("llama3_text"),
        tp.chat_text("chatml", system, F.col("prompt"), F.col("reply")).alias("chatml_text"),
    )


def snippets(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.snippet(F.col("text"), 2).alias("snippet"))


def extract_items(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    # A reply is prose here, so its sentences are laid out as numbered lines first.
    numbered = F.array_join(
        F.transform(tx.sentences(F.col("text")), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n"
    )
    return c.select("conv_id", "turn", F.posexplode(tx.list_items(numbered)).alias("item_no", "item"))


def reply_fields(spark, sf):
    """Score, verdict and feedback fields of reviews written over the replies' own figures."""
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    words = F.size(tx.tokens(F.col("text")))
    review = F.concat(
        F.lit("Score: "), (words / 10).cast("decimal(10,1)").cast("string"),
        F.lit("\nFEEDBACK:\n- words "), words.cast("string"), F.lit("\n* chars "), F.length("text").cast("string"),
        F.lit("\nSCORE: 0."), F.lpad((words % 100).cast("string"), 2, "0"), F.lit("\nRATIONALE: counted "), words.cast("string"),
    )
    r = c.select("conv_id", "turn", review.alias("review"))
    return r.select(
        "conv_id", "turn",
        tx.score_field(F.col("review")).alias("score"),
        tx.verdict_score(F.col("review")).alias("verdict"),
        tx.verdict_rationale(F.col("review")).alias("rationale"),
        F.array_join(tx.feedback_items(F.col("review")), "; ").alias("feedback"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        section_split, chunk_fixed, chunk_sentence, token_counts, tokens_stemmed, pii_scrub, dedupe_documents,
        length_filter, cleaning_report, document_cleaning_report, cleaned_documents, stratified_split, chat_render,
        snippets, extract_items, reply_fields,
    )
}

# --- oracles -------------------------------------------------------------------

SPACE_SQL = "'" + fixed.SPACE_CHARS + "'"
SP = fixed.SPACE_CLASS


def strip_sql(x: str) -> str:
    return f"trim({x}, {SPACE_SQL})"


def sentences_sql(x: str, enders: str = ".!?") -> str:
    marked = rf"regexp_replace({x}, '([{enders}]){SP}+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip_sql('s')}), lambda s: s <> '')"


def tokens_sql(x: str, pattern: str = fixed.WORD) -> str:
    return f"regexp_extract_all(lower({x}), '{pattern.replace(chr(39), chr(39) * 2)}')"


def words_sql(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def snippet_sql(x: str, n: int = 2) -> str:
    marked = rf"regexp_replace({strip_sql(x)}, '(\.){SP}+', '\1' || chr(1), 'g')"
    return f"array_to_string(list_slice(string_split({marked}, chr(1)), 1, {n}), ' ')"


def search_terms_sql(x: str) -> str:
    stops = words_sql(fixed.SEARCH_STOP_WORDS)
    return (
        f"list_transform(list_filter({tokens_sql(x)}, lambda t: NOT list_contains({stops}, t)), "
        "lambda t: CASE WHEN length(t) > 3 AND t LIKE '%s' THEN t[1:length(t)-1] ELSE t END)"
    )


# Word characters, digits and blanks of Unicode, as the query's patterns read them; MARK and SEEN are no characters of texts.
_W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}\x{24b6}-\x{24e9}\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}\x{1f170}-\x{1f189}"
_MARK, _SEEN = r"\x{fdd0}", r"\x{fdd1}"


def scrub_sql(x: str) -> str:
    """The query's two patterns without look-around: what they look at is marked first, and the marks go again.

    A word is marked once in front and twice behind, so an address that starts
    where another ends still finds its boundary. For numbers, MARK stands where
    one may start and SEEN where one may end.
    """
    m, s = _MARK, _SEEN
    words = f"regexp_replace({x}, '([{_W}]+)', chr(64976) || '\\1' || chr(64976) || chr(64976), 'g')"
    mail = rf"{m}(?:{m}{{0,2}}[A-Za-z0-9._%+-])+{m}{{0,2}}@(?:{m}{{0,2}}[A-Za-z0-9.-])+{m}{{0,2}}\.{m}[A-Za-z]{{2,}}{m}"
    no_mail = f"regexp_replace(regexp_replace({words}, '{mail}', '{fixed.EMAIL_MARK}', 'g'), '{m}', '', 'g')"
    starts = rf"chr(64976) || regexp_replace({no_mail}, '([^{_W}.])', '\1' || chr(64976), 'g')"
    ends = rf"regexp_replace({starts}, '([^{_W}{m}-])', chr(64977) || '\1', 'g') || chr(64977)"
    o, d, gap = f"[{m}{s}]*", r"\p{Nd}", r"[-.\t-\r\x{85}\p{Z}]"
    number = rf"{m}{o}(?:\+?{o}{d}{{1,3}}{o}(?:{gap}{o})?)?(?:\({o}{d}{{3}}{o}\)|{d}{{3}}){o}{gap}{o}{d}{{3}}{o}{gap}{o}{d}{{4}}{s}"
    no_number = f"regexp_replace(regexp_replace({ends}, '{number}', '{fixed.PHONE_MARK}', 'g'), '[{m}{s}]', '', 'g')"
    # No number without four digits in a row, no address without its sign: other texts need no marks.
    return f"CASE WHEN regexp_matches({x}, '{d}{{4}}') THEN {no_number} WHEN contains({x}, '@') THEN {no_mail} ELSE {x} END"


def key_sql(x: str) -> str:
    return rf"regexp_replace(lower({strip_sql(x)}), '{SP}+', ' ', 'g')"


def _clean_sql(source: str, low: int, high: int) -> str:
    return f"""
WITH src AS ({source}),
s AS (SELECT id, i, r, {scrub_sql('i')} AS ni, {scrub_sql('r')} AS nr FROM src),
k AS (SELECT *, row_number() OVER (PARTITION BY {key_sql('ni')} ORDER BY id) AS rn FROM s)"""


def _report_sql(source: str, low: int, high: int) -> str:
    fits = f"length(ni) + length(nr) BETWEEN {low} AND {high}"
    return _clean_sql(source, low, high) + f"""
SELECT count(*) AS input_count, count(*) FILTER (rn = 1 AND {fits}) AS output_count,
       count(*) FILTER (rn > 1) AS duplicates_removed,
       count(*) FILTER (rn = 1 AND NOT ({fits})) AS length_filtered,
       count(*) FILTER (ni <> i OR nr <> r) AS pii_scrubbed FROM k"""


_DOC_SOURCE = "SELECT doc_id AS id, text AS i, '' AS r FROM documents"
_PAIR_SOURCE = (
    f"SELECT lpad(conv_id::VARCHAR, 12, '0') || '-' || lpad(turn::VARCHAR, 6, '0') AS id, prompt AS i, reply AS r FROM ({PAIRS_SQL})"
)


def _template_sql(template: str) -> str:
    import string

    bits = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            bits.append("'" + literal.replace("'", "''") + "'")
        if name:
            bits.append(name)
    return " || ".join(bits)


ORACLES = {
    "section_split": rf"""
WITH p AS (SELECT page_id, string_split(regexp_replace(html, '(<h[1-6]>)', chr(1) || '\1', 'g'), chr(1)) AS pieces FROM pages),
f AS (
  SELECT page_id, list_filter(list_transform(pieces, lambda x: {{
    'section': CASE WHEN regexp_matches(x, '^<h[1-6]>') THEN {strip_sql("regexp_extract(x, '^<h[1-6]>([^<]*)', 1)")} END,
    'body': {strip_sql("regexp_replace(x, '^<h[1-6]>[^<]*(</h[1-6]>)?', '')")}}}), lambda s: s.body <> '') AS s FROM p)
SELECT page_id, (i - 1)::INT AS section_no, s[i].section AS section, s[i].body AS body
FROM f, unnest(range(1, len(s) + 1)) AS u(i)""",
    "chunk_fixed": f"""
WITH c AS (
  SELECT doc_id, list_filter(list_transform(
    range(0, ceil(greatest(length(text) - {CHUNK_SIZE}, 0) / {CHUNK_SIZE - CHUNK_OVERLAP}.0)::BIGINT + 1),
    lambda i: {strip_sql(f"substring(text, i * {CHUNK_SIZE - CHUNK_OVERLAP} + 1, {CHUNK_SIZE})")}), lambda x: x <> '') AS pieces
  FROM documents)
SELECT doc_id, (i - 1)::INT AS position, pieces[i] AS chunk FROM c, unnest(range(1, len(pieces) + 1)) AS u(i)""",
    "chunk_sentence": f"""
WITH s AS (SELECT doc_id, {sentences_sql('text')} AS ss FROM documents),
p AS (
  SELECT doc_id, string_split(list_reduce(ss, lambda a, x:
    CASE WHEN length(string_split(a, chr(2))[-1]) + 1 + length(x) > {PACK_SIZE} THEN a || chr(2) || x ELSE a || ' ' || x END),
    chr(2)) AS pieces FROM s WHERE len(ss) > 0)
SELECT doc_id, (i - 1)::INT AS position, pieces[i] AS chunk FROM p, unnest(range(1, len(pieces) + 1)) AS u(i)""",
    "token_counts": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY ALL",
    "tokens_stemmed": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({search_terms_sql('text')}) AS term FROM documents) GROUP BY ALL",
    "pii_scrub": f"SELECT doc_id, {scrub_sql('text')} AS text FROM documents",
    "dedupe_documents": f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {key_sql('text')}",
    "length_filter": "SELECT doc_id, source, length(text)::INT AS chars FROM documents WHERE length(text) BETWEEN 40 AND 4000",
    "cleaning_report": _report_sql(_PAIR_SOURCE, 40, 1500),
    "document_cleaning_report": _report_sql(_DOC_SOURCE, 40, 4000),
    "cleaned_documents": _clean_sql(_DOC_SOURCE, 40, 4000)
    + "\nSELECT id AS doc_id, length(ni)::INT AS chars FROM k WHERE rn = 1 AND length(ni) + length(nr) BETWEEN 40 AND 4000",
    "stratified_split": """
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('13:' || doc_id::VARCHAR), doc_id) AS rn,
  count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN rn <= round_even(n * 0.8, 0) THEN 'train'
  WHEN rn <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'test' END AS split FROM r""",
    "chat_render": f"""
SELECT conv_id, turn, {_template_sql(fixed.LLAMA3_FORMAT)} AS llama3_text, {_template_sql(fixed.CHATML_FORMAT)} AS chatml_text
FROM (SELECT conv_id, turn, coalesce(system, '{fixed.DEFAULT_SYSTEM_PROMPT}') AS system, prompt AS "user", reply AS assistant
      FROM ({PAIRS_SQL}))""".replace("|| user ||", '|| "user" ||'),
    "snippets": f"SELECT doc_id, {snippet_sql('text')} AS snippet FROM documents",
    "extract_items": rf"""
WITH s AS (SELECT conv_id, turn, list_transform({sentences_sql('text')}, lambda x: regexp_replace(x, '{SP}*[\n\r\x0b\x0c\x1c-\x1e\x85\x{{2028}}\x{{2029}}].*', '', 's')) AS ss
  FROM conversations WHERE role = 'assistant'),
d AS (SELECT conv_id, turn, list_filter(ss, lambda x, i: list_position(ss, x) = i) AS items FROM s)
SELECT conv_id, turn, (i - 1)::INT AS item_no, items[i] AS item FROM d, unnest(range(1, len(items) + 1)) AS u(i)""",
    "reply_fields": f"""
WITH w AS (SELECT conv_id, turn, len({tokens_sql('text')}) AS w, length(text) AS n FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, least(w / 10.0, 10.0)::DOUBLE AS score, (w % 100)::DOUBLE / 100 AS verdict,
  'counted ' || w AS rationale, 'words ' || w || '; chars ' || n AS feedback FROM w""",
}
