import duckdb
import pytest
from pyspark.sql import functions as F

from brightloom.functions import fixed, text as tx
from brightloom.operators import text_prep as tp
from brightloom.plans.text_queries import scrub_sql


def test_fixed_windows(one):
    body = "".join(chr(65 + i % 26) for i in range(100))
    got = one(tx.fixed_chunks(F.col("t"), 40, 10), t=body)
    assert got[0] == body[:40] and got[1] == body[30:70] and got[-1].endswith(body[-1])
    assert one(tx.fixed_chunks(F.col("t"), 40, 10), t=" \n ") == []
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            tx.fixed_chunks(F.col("t"), size, overlap)


def brute_windows(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        if text[start : start + size].strip():
            out.append(text[start : start + size].strip())
        if start + size >= len(text):
            break
        start += size - overlap
    return out


def brute_packing(text, size):
    import re

    out, buffer = [], []
    for s in [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]:
        if buffer and len(" ".join([*buffer, s])) > size:
            out.append(" ".join(buffer))
            buffer = []
        buffer.append(s)
    return out + ([" ".join(buffer)] if buffer else [])


def test_chunks_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(
        "text", tx.fixed_chunks(F.col("text"), 100, 30).alias("w"), tx.sentence_chunks(F.col("text"), 120).alias("s")
    )
    for r in docs.collect():
        assert r["w"] == brute_windows(r["text"], 100, 30)
        assert r["s"] == brute_packing(r["text"], 120)


def test_sentence_packing(one):
    text = "One two three. Four five six. Seven eight nine."
    assert one(tx.sentence_chunks(F.col("t"), 30), t=text) == ["One two three. Four five six.", "Seven eight nine."]
    long = "x" * 50 + "."
    assert one(tx.sentence_chunks(F.col("t"), 10), t=f"A. {long} B.") == ["A.", long, "B."]


def test_chunk_table_numbers_from_zero(spark):
    df = spark.createDataFrame([(7, "abcdef", "src")], "id int, text string, source string")
    rows = tp.chunk_documents(df, "text", "id", "source", size=3, overlap=0).orderBy("position").collect()
    assert [(r["position"], r["chunk"], r["source"]) for r in rows] == [(0, "abc", "src"), (1, "def", "src")]


def test_tokens(one):
    assert one(tx.tokens(F.col("t")), t="Hello, World! v2.0") == ["hello", "world", "v2", "0"]
    got = one(tx.tokens(F.col("t"), fixed.CONTRACTION_WORD), t="Can't reach VPN-server (error 0x8007)!")
    assert got == ["can't", "reach", "vpn", "server", "error", "0x8007"]
    assert one(tx.search_terms(F.col("t")), t="The cats of gas and bus lines") == ["cat", "gas", "bus", "line"]
    assert one(tx.content_keywords(F.col("t")), t="The answer is 42, at v1.5. Ok 42.") == ["answer", "42", "v1.5"]


@pytest.mark.parametrize("number", ["+1-555-123-4567", "(555) 123-4567", "555.123.4567"])
def test_phone(one, number):
    assert one(tx.scrub(F.col("t")), t=f"call {number} now") == "call [PHONE] now"


def test_scrub_other(one):
    assert one(tx.scrub(F.col("t")), t="mail a.b+c@x-y.org, ok") == "mail [EMAIL], ok"
    assert one(tx.scrub(F.col("t")), t="ticket 1234567 and 10.0.0.1") == "ticket 1234567 and 10.0.0.1"


@pytest.mark.parametrize("text", [
    "ña@b.com", "a@b.comß", "é.x@b.com", "a@b.com+c@d.com", "555-123-4567(212) 555-0153", "555-123-4567+1 555-123-4567",
    "555\u00a0123\u00a04567", "555-123-4567é", "٣٤٥-123-4567", "1 555-123-4567 (212) 555-0153 +1 (227) 555-6608",
])
def test_scrub_sql_states_the_same_rule(one, text):
    want = duckdb.execute(f"SELECT {scrub_sql('t')} FROM (SELECT ? AS t)", [text]).fetchone()[0]
    assert one(tx.scrub(F.col("t")), t=text) == want


def test_cleaning(spark):
    long = "please help with the printer on floor three today"
    rows = [
        (1, f"Mail bob@x.com {long}", "done"), (2, f"mail  amy@y.org {long}".upper().replace("AMY@Y.ORG", "amy@y.org"), "later"),
        (3, "short", "x"), (4, f"Other {long}", "ok"),
    ]
    df = spark.createDataFrame(rows, "id int, i string, r string")
    kept = tp.clean_examples(df, "id", "i", "r").orderBy("id").collect()
    assert [r["id"] for r in kept] == [1, 4]
    report = tp.cleaning_report(df, "id", "i", "r").first().asDict()
    assert report == {"input_count": 4, "output_count": 2, "duplicates_removed": 1, "length_filtered": 1, "pii_scrubbed": 2}


def test_split_is_exact_complete_and_seeded(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 333, "a").otherwise("b").alias("c"))
    out = tp.stratified_split(df, "c", "id")
    counts = {(r["c"], r["split"]): r["count"] for r in out.groupBy("c", "split").count().collect()}
    assert counts == {("a", "train"): 266, ("a", "val"): 33, ("a", "test"): 34, ("b", "train"): 534, ("b", "val"): 67, ("b", "test"): 66}
    assert out.select("id").distinct().count() == 1000
    again = tp.stratified_split(df, "c", "id").exceptAll(out).count()
    other = tp.stratified_split(df, "c", "id", seed=14).exceptAll(out).count()
    assert again == 0 and other > 0
    for train, val in ((0.0, 0.1), (0.9, 0.1), (0.5, 1.0)):
        with pytest.raises(ValueError):
            tp.stratified_split(df, "c", "id", train, val)


def test_templates(one):
    args = {"system": F.lit("S"), "user": F.lit("U"), "assistant": F.lit("A")}
    assert one(tp.chat_text("chatml", **args)) == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>\n<|im_start|>assistant\nA<|im_end|>\n"
    llama = one(tp.chat_text("llama3", **args))
    assert llama.startswith("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nS<|eot_id|>") and llama.endswith("\n\nA<|eot_id|>")
    with pytest.raises(KeyError):
        tp.chat_text("nope", **args)


def test_list_items(one):
    assert one(tx.list_items(F.col("t")), t="Plan:\n1. What is A?\n2) How is B?\n- Third\n1. What is A?") == ["What is A?", "How is B?", "Third"]
    assert one(tx.list_items(F.col("t")), t="Sure.\nWhat is A?\nWhat is A?\nok") == ["What is A?"]


def test_reply_fields(one):
    review = "SCORE: 12.5\nnotes\n- not yet\nFEEDBACK:\n- one\n* two\nplain"
    assert one(tx.score_field(F.col("t")), t=review) == 10.0
    assert one(tx.score_field(F.col("t")), t="nothing") is None
    assert one(tx.feedback_items(F.col("t")), t=review) == ["one", "two"]
    assert one(tx.feedback_items(F.col("t")), t="- a") == []
    assert one(tx.verdict_score(F.col("t")), t="SCORE: 0.75\nRATIONALE: fine ") == 0.75
    assert one(tx.verdict_rationale(F.col("t")), t="SCORE: 0.75\nRATIONALE: fine ") == "fine"
    assert one(tx.verdict_score(F.col("t")), t="no verdict") == 0.0


def test_sections(one):
    md = "intro\n\n# One\nbody 1\n\n##   Two  \n\n### Three\nx\ny\n#nope"
    got = [(s["section"], s["body"]) for s in one(tx.sections(F.col("t")), t=md)]
    assert got == [(None, "intro"), ("One", "body 1"), ("Three", "x\ny\n#nope")]


def test_unicode_space(one):
    assert one(tx.strip(F.col("t")), t="  　x y \n") == "x y"
    assert one(tx.sentences(F.col("t")), t="Un. Deux! Trois") == ["Un.", "Deux!", "Trois"]
