"""Registered queries of the corpus operators and their DuckDB oracles.

Each query applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brightloom.llm import (
    bpe, chat, exact_dedup, fim, html_text, jaccard, minhash, mixing, nra, quality, sharding, sketches, urls,
)
from brightloom.sources.tables import table


def op1_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages").select("page_id", "html")).select("page_id", "text")


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf, "documents"))


def op3_bpe(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = bpe.public_vocabulary("byte_bpe_50k.json")
    encoded = bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), vocabulary).drop("text")
    return bpe.decode(encoded, vocabulary).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf, "labels")))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op5_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    counts = urls.word_counts(pages, "html")
    return urls.judge(pages.select("page_id", "url"), counts).select("page_id", "host", "path", "rule", "verdict", "block_odds")


#: Bytes of text per shard.
SHARD_BYTES = 1 << 20


def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign(table(spark, sf, "documents"), SHARD_BYTES)


def op7_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.fingerprints(table(spark, sf, "documents"))


def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = exact_dedup.classify(table(spark, sf, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.classify(table(spark, sf, "documents"), width=4, percent=85)


def op9_chat(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    records = chat.gather(rows.unionByName(extra), "conv_id", "turn", "role", "text")
    written = chat.format_records(records, ["messages"]).select("conv_id", "formatted", "loss_mask")
    read = written.withColumn("turns", chat.parse_turns(F.col("formatted")))
    masked = F.filter(F.arrays_zip("turns", "loss_mask"), lambda x: x["loss_mask"])
    read = read.withColumn("trained", F.array_join(F.transform(masked, lambda x: x["turns"]["text"]), ""))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_fim(spark: SparkSession, sf: str) -> DataFrame:
    made = fim.transform(table(spark, sf, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


def op12_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.classify(table(spark, sf, "documents"), width=5, percent=85)


def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return nra.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)


QUERIES = {
    "op1_html_text": op1_html_text, "op2_mixing": op2_mixing, "op3_bpe": op3_bpe, "op4_quality": op4_quality, "op5_url_filter": op5_url_filter,
    "op6_sharding": op6_sharding, "op7_fingerprints": op7_fingerprints, "op8_exact_dedup": op8_exact_dedup, "op9_chat": op9_chat,
    "op10_ngram_join": op10_ngram_join, "op11_fim": op11_fim, "op12_minhash": op12_minhash, "op13_ranked_search": op13_ranked_search,
}

OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn
  FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight,
         (3 * source_size)::DOUBLE AS cap FROM totals
), levels AS (
  SELECT *, cap / weight AS level,
         coalesce(sum(cap) OVER up, 0) AS cap_before, sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS weight_left,
         (sum(source_size) OVER ())::DOUBLE AS total
  FROM weighted WINDOW up AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (SELECT *, cap_before + level * weight_left <= total AS full_up FROM levels),
rates AS (
  SELECT source, source_size, CASE WHEN full_up THEN cap ELSE weight *
    ((total - sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER ()) END AS target
  FROM capped
), drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS chance
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
), copied AS (
  SELECT *, floor(rate)::BIGINT + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM drawn
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM copied
"""

OP6_SQL = f"""
WITH hashed AS (
  SELECT row_number() OVER () AS row_no, doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM documents
), nested AS (
  SELECT h.*, d.depth, h.hash >> (60 - d.depth) AS prefix FROM hashed h, (SELECT unnest(range(0, 61))::INT AS depth) d
), totals AS (
  SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM nested GROUP BY depth, prefix
), ranked AS (
  SELECT n.row_no, n.doc_id, n.bytes, n.depth, n.prefix, t.shard_bytes, t.shard_rows,
         row_number() OVER (PARTITION BY n.row_no ORDER BY n.depth) AS nth
  FROM nested n JOIN totals t USING (depth, prefix)
  WHERE t.shard_bytes <= {SHARD_BYTES} OR t.shard_rows = 1 OR n.depth = 60
)
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth, shard_bytes, shard_rows,
       shard_bytes <= {SHARD_BYTES} AS fits
FROM ranked WHERE nth = 1
"""

OP8_SQL = """
WITH normal AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normalised FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM normal WINDOW same AS (PARTITION BY normalised)
"""

OP9_SQL = r"""
WITH rows_in AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(regexp_replace(text, '{break}', '\1\\\2', 'g')) AS text_chars,
         length(replace(replace(regexp_replace(role, '{break}', '\1\\\2', 'g'), '%', '%25'), chr(10), '%0A')) AS role_chars
  FROM rows_in
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS trained,
         sum(text_chars + role_chars + {frame}) AS formatted_chars
  FROM escaped GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(trained)::BIGINT AS loss_chars,
       sha256(trained) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM joined
""".replace("{break}", chat._BREAK).replace("{frame}", str(len(chat.START) + len(chat.END) + 2))

def _linked_sql(width: int, percent: int) -> str:
    """(doc_id, n_shingles, component_id): every pair that shares a shingle is counted, then links are followed to their ends."""
    run = " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER o" for k in range(1, width)]])
    return rf"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS words FROM documents
), units AS (SELECT row_no, unnest(words) AS word, unnest(range(len(words))) AS place FROM cut),
runs AS (SELECT row_no, {run} AS shingle FROM units WINDOW o AS (PARTITION BY row_no ORDER BY place)),
each AS (
  SELECT DISTINCT row_no, shingle FROM runs WHERE shingle IS NOT NULL
  UNION ALL SELECT row_no, array_to_string(words, ' ') FROM cut WHERE len(words) BETWEEN 1 AND {width - 1}
), sized AS (SELECT row_no, count(*)::BIGINT AS n FROM each GROUP BY 1),
pairs AS (SELECT a.row_no AS x, b.row_no AS y, count(*) AS common FROM each a JOIN each b ON a.shingle = b.shingle AND a.row_no <> b.row_no GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sized a ON a.row_no = x JOIN sized b ON b.row_no = y WHERE 100 * common >= {percent} * (a.n + b.n - common)
), reach AS (
  SELECT row_no, row_no AS met FROM cut UNION SELECT reach.row_no, links.y FROM reach JOIN links ON links.x = reach.met
), found AS (SELECT reach.row_no, min(doc_id) AS component_id FROM reach JOIN cut ON cut.row_no = reach.met GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM cut JOIN found USING (row_no) LEFT JOIN sized USING (row_no)
"""


OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents
), numbers AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM cut
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS one, greatest(h1 % (n + 1), h2 % (n + 1)) AS two,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
  SELECT *, array_to_string(units[1:one], '') AS prefix, array_to_string(units[one + 1:two], '') AS middle,
         array_to_string(units[two + 1:n], '') AS suffix FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

OP13_SQL = r"""
WITH found AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), sized AS (SELECT row_no, doc_id, terms, len(terms)::BIGINT AS n FROM found WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sized),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), postings AS (
  SELECT row_no, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row_no, doc_id, n, unnest(terms) AS term FROM sized)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weighed AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), totals
), scored AS (
  SELECT item_id, row_no, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
  FROM wanted JOIN postings USING (term) JOIN weighed USING (term), totals GROUP BY item_id, row_no, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

ORACLES = {
    "op10_ngram_join": _linked_sql(4, 85),
    "op12_minhash": f"SELECT *, doc_id = component_id AS kept FROM ({_linked_sql(5, 85)})",
    "op11_fim": OP11_SQL, "op13_ranked_search": OP13_SQL, "op2_mixing": OP2_SQL, "op6_sharding": OP6_SQL, "op8_exact_dedup": OP8_SQL,
    "op9_chat": OP9_SQL,
}
