"""HTML extraction, BPE, quality classifier and URL filters."""

import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brightloom.llm import bpe, html_text, quality, urls

VOCABULARY = bpe.public_vocabulary("byte_bpe_50k.json")


# --- HTML -------------------------------------------------------------------

@pytest.mark.parametrize("html, text", [
    ("", ""),
    ("<p>One<p>Two <b>bold</b>text", "One\n\nTwo boldtext"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>z", "- a\n- b\n  3. x\n  4. y\n\nz"),
    ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>", "Name      | N\nlong name | 1"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
    ("<td>loose</td>", "loose"),
    ("x<script>var a='<p>no</p>'</script><style>p{}</style>y", "xy"),
    ("<div hidden>no</div><p style='DISPLAY : none'>no<p>yes", "yes"),
    ("<p style='visibility:hidden'>no <i style='visibility:visible'>yes</i></p>", "yes"),
    ("<details><summary>S</summary>no</details><details open>yes</details>", "S\nyes"),
    ("<pre>\n a\n   b</pre>", " a\n   b"),
    ("a &lt;b&gt; &amp; &#233; &nosuch;", "a <b> & é &nosuch;"),
    ("<!-- no --><!doctype html><?x y?>a<![CDATA[b]]>", "a"),
    ("<blockquote>q<p>r</blockquote>", "> q\n>\n> r"),
    ("a < b <3 c", "a < b <3 c"),
    ("<title>no</title>text</p></div></b>", "text"),
    ("<p>a<!-->b<p>c", "ab\n\nc"), ("<p>a<!--->b", "ab"), ("<p>a<!-- x --!>b<p>c", "ab\n\nc"), ("<p>a<!--!>no--><p>c", "a\n\nc"),
    ("<p>a<!-- no <!--> b", "a b"), ("<p>a<!-- no", "a"),
])
def test_visible_text(html, text):
    assert html_text.visible_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("<p>Area <math><mi>a</mi><mo>=</mo><mn>4</mn></math> ok</p>", "Area a=4 ok"),
    ("<math><semantics><mi>x</mi><annotation encoding='application/x-tex'>no</annotation><annotation-xml><ci>no</ci></annotation-xml></semantics></math>y", "xy"),
    ("<math><mfrac><mn>1</mn><mn>2</mn></mfrac><mphantom><mi>no</mi></mphantom></math>", "1 2"),
    ("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr></mtable></math>", "1 2"),
    ("<p>a<svg><path d='M0'/><text x=1>one <tspan>two</tspan></text><text>three</text></svg>b", "a one two three b"),
    ("<svg><title>no</title><desc>no</desc><metadata>no</metadata><defs><text>no</text></defs>"
     "<symbol><text>no</text></symbol><text>yes</text></svg>", "yes"),
    ("<svg><defs/><title/><style/><text>yes</text></svg><p>on", "yes\n\non"),
    ("<p>a<svg><foreignObject><p>b</p><ul><li>c</ul></foreignObject></svg>d</p>", "a\n\nb\n\n- c\n\nd"),
    ("x<svg>no browser support<g>no</g><text display='none'>no</text><text visibility='hidden'>no</text></svg>y", "xy"),
    ("<svg><switch><foreignObject><div>label</div></foreignObject><text>label</text></switch></svg>", "label"),
    ("<svg><text><![CDATA[a < b]]></text></svg>", "a < b"),
    ("<svg><defs><g><p>yes", "yes"),
    ("<head><svg><text>a</text></svg>", "a"),
])
def test_formulas_and_drawings(html, text):
    assert html_text.visible_text(html) == text


def test_deep_drawings_are_read():
    assert html_text.visible_text("<svg>" + "<g>" * 20_000 + "<text>deep") == "deep"


def test_any_markup_is_read():
    rng = random.Random(5)
    for _ in range(300):
        html_text.visible_text("".join(rng.choice(["<", ">", "/", "p", "td", "<li>", "<table>", "</ul>", "'", '"', " ", "x", "&", "<!--"]) for _ in range(60)))
    assert html_text.visible_text("<div>" * 20_000 + "deep") == "deep"


def test_stray_tags_under_a_deep_stack_take_no_scan_each():
    begin = time.time()
    assert html_text.visible_text("<div>" * 20_000 + "<li></ul>" * 20_000 + "end").endswith("- end")
    assert time.time() - begin < 20


def test_clashing_names_are_replaced(spark):
    pages = spark.createDataFrame([(1, "<p>a", "x", "y")], "page_id int, html string, TEXT string, Text string")
    assert html_text.extract(pages).select("page_id", "text").collect() == [(1, "a")]


def test_extract_keeps_rows_and_columns(spark):
    pages = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "x"), (2, None, None), (None, "", "y")], "page_id int, html string, Text string")
    got = html_text.extract(pages, text="out")
    assert got.columns == ["page_id", "html", "Text", "out"]
    assert sorted(map(str, (tuple(r) for r in got.select("page_id", "out").collect()))) == sorted(
        map(str, [(1, "a"), (1, "a"), (2, ""), (None, "")]))
    assert html_text.extract(pages.limit(0), text="out").count() == 0


# --- BPE --------------------------------------------------------------------

@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def test_codec_equals_the_library(public, small):
    import pyarrow.parquet as pq

    rng = random.Random(1)
    texts = [x or "" for x in pq.read_table(f"{small}/documents.parquet")["text"].to_pylist()]
    for _ in range(400):
        texts.append("".join(rng.choice("abcdeé 1.\n'ſ\x85\u2028日\U0001F600") for _ in range(rng.randrange(200))))
    texts += ["<|endoftext|>", "a <|endoftext|>  <|endoftext|>b", "<|endoftext", "", " ", "ab" * 5000, "x" * 65, "日" * 30, "é" * 33]
    codec = bpe.Codec(VOCABULARY)
    for text, packed, want in zip(texts, codec.encode_all(texts), public.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == want.ids
        assert codec.decode(packed) == public.decode(want.ids, skip_special_tokens=False) == text


def test_lockstep_trees_equal_single_trees():
    codec, rng = bpe.Codec(VOCABULARY), random.Random(2)
    raws = [bytes(rng.choice(b"thersingoa \xc3\xa9") for _ in range(rng.randrange(1, 17))) for _ in range(500)]
    assert codec.merge_many(raws, 16) == [np.asarray(codec.merge(r), "<u4").tobytes() for r in raws]


def test_cache_is_bounded(monkeypatch, public):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 20)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 200)
    codec = bpe.Codec(VOCABULARY)
    texts = [" ".join(f"w{i * j}" for i in range(40)) for j in range(30)]
    got = [np.frombuffer(x, "<u4").tolist() for x in codec.encode_all(texts)]
    assert got == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


def test_encode_and_decode_rows(spark):
    docs = spark.createDataFrame([(1, "Hello there", 7), (1, "Hello there", 7), (2, None, 8), (3, "", None)], "doc_id int, text string, IDS int").withColumn("DECODED", F.lit(1))
    rows = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).orderBy("doc_id").collect()
    assert [(r.doc_id, r.decoded, len(r.ids) // 4) for r in rows] == [(1, "Hello there", 2), (1, "Hello there", 2), (2, "", 0), (3, "", 0)]
    assert bpe.encode(docs.limit(0), VOCABULARY).count() == 0


# --- quality ----------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels)).where(quality.held_out(F.col("doc_id")))
    rows = scored.join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.97
    assert sum(g >= quality.THRESHOLD for g in good) / len(good) > 0.95
    assert sum(b >= quality.THRESHOLD for b in bad) / len(bad) < 0.2


def test_the_fit_equals_a_plain_loop(spark):
    """Fifty labelled rows: weights of the fitted model against follow-the-regularised-leader written out per feature."""
    rng = random.Random(12)
    words = ["good", "bad", "Fine", "junk!!", "text", "7", "of"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("good" in t)) for i, t in rows], "doc_id long, quality int")
    got = quality.train(docs, labels, rows=1000, epochs=2)

    usable = [(i, t, "good" in t) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    hashed = spark.createDataFrame([(e, str(i)) for e in (1, 2) for i, _, _ in usable], "epoch int, doc_id string")
    order = [(r.epoch, r.doc_id) for r in hashed.orderBy("epoch", F.xxhash64("epoch", "doc_id"), "doc_id").collect()]
    z, n, by_id = {}, {}, {str(i): (t, y) for i, t, y in usable}

    def weight(k):
        if abs(z.get(k, 0.0)) <= quality.L1:
            return 0.0
        sign = 1 if z[k] > 0 else -1
        return -(z[k] - sign * quality.L1) / ((quality.BETA + n[k] ** 0.5) / quality.ALPHA + quality.L2)

    for _, i in order:
        text, y = by_id[i]
        x = {}
        for at, value in zip(*quality.features(text, quality._Tokens())):
            x[int(at)] = x.get(int(at), 0.0) + float(value)
        x = {k: float(np.float32(v)) for k, v in x.items()} | {quality.DIMENSIONS: 1.0}
        p = 1 / (1 + np.exp(-sum(weight(k) * v for k, v in x.items())))
        for k, v in x.items():
            g, before = (p - y) * v, n.get(k, 0.0)
            w = weight(k)
            n[k] = before + g * g
            z[k] = z.get(k, 0.0) + g - (n[k] ** 0.5 - before**0.5) / quality.ALPHA * w
    want = np.zeros(quality.DIMENSIONS + 1)
    for k in z:
        want[k] = weight(k)
    assert got == pytest.approx(want, abs=1e-5) and len(usable) >= 50 and (want != 0).sum() > 20


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good text here", "a"), (1, "good text here", "a"), (2, None, "b"), (3, "", None), (None, "BAD!! BAD!!", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, None)], "doc_id long, quality int")
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    none = quality.train(docs, labels.limit(0))
    assert not none.any() and {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_scores_ignore_everything_but_the_text(spark):
    weights = np.random.default_rng(0).normal(size=quality.DIMENSIONS + 1).astype("f4")
    a, b = (quality.score(spark.createDataFrame([(i, "same words", s)], "doc_id int, text string, source string"), weights).first().score for i, s in ((1, "x"), (2, "y")))
    assert a == b


def test_a_sparse_dot_product_is_the_sum_over_n_grams():
    known = quality._Tokens()
    at, value = quality._sparse("one two one two !!", known)
    w = np.arange(quality.DIMENSIONS + 1) % 7 / 10
    plain = quality.features("one two one two !!", known)
    assert w[at] @ value == pytest.approx(w[plain[0]] @ plain[1])


# --- urls -------------------------------------------------------------------

URLS = [
    ("http://A.Example.NET/en/1", "a.example.net", "/en/1", "example.net/en/"),
    ("https://example.net/de/?x", "example.net", "/de/", "net/"),
    ("https://badexample.com/de/1", "badexample.com", "/de/1", None),
    ("https://m.example.com/de/1#x/y", "m.example.com", "/de/1", "example.com/de/"),
    ("x://y.org?/fr/", "y.org", "", None),
    ("http://org/fr/a://b", "org", "/fr/a://b", "org/fr/"),
    ("no scheme", "", "", None),
    (None, "", "", None),
    ("http://net", "net", "", None),
]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(u,) for u, *_ in URLS], "url string")
    got = df.select("url", urls.host_of(F.col("url")).alias("h"), urls.path_of(F.col("url")).alias("p"))
    got = got.withColumn("r", urls.rule_of(F.col("h"), F.col("p")))
    assert [tuple(r) for r in got.collect()] == URLS


def test_viterbi_finds_the_likeliest_split():
    counts = {"the": 50, "ring": 20, "thering": 1, "her": 5, "in": 30, "g": 1, "t": 1}
    s = urls.Segmenter(counts)

    def best(run):
        if not run:
            return 0.0, []
        return min((s.cost.get(run[:k], s.unknown[k]) + best(run[k:])[0], [run[:k], *best(run[k:])[1]]) for k in range(1, len(run) + 1))

    for run in ("thering", "ringin", "xthe", "ththe", "q"):
        cost = sum(s.cost.get(w, s.unknown[len(w)]) for w in s.split(run))
        assert "".join(s.split(run)) == run and cost == pytest.approx(best(run)[0])
    assert s.host("ring-the.net") == ["h:ring", "h:the", *[f"h:{w}" for w in s.split("net")]]
    part = urls.Segmenter({"ring": 20, "the": 50}, sum(counts.values()))
    assert part.cost == {w: s.cost[w] for w in ("ring", "the")} and part.unknown == s.unknown


def test_naive_bayes_against_brute_force(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    counts = urls.word_counts(pages, "html")
    rows = urls.judge(pages.select("page_id", "url"), counts).collect()
    every = {r.word: r.n for r in counts.collect()}
    said, s = dict((r, v) for v, r in urls.RULES), urls.Segmenter(every)
    tokens = {r.page_id: s.host(r.host) + [f"p:{t}" for t in urls._RUNS.findall(r.path.lower())] for r in rows}
    assert all(r.tokens == tokens[r.page_id] for r in rows)
    seen = {"block": {}, "allow": {}}
    docs = {"block": 0, "allow": 0}
    for r in rows:
        if r.rule:
            docs[said[r.rule]] += 1
            for t in tokens[r.page_id]:
                seen[said[r.rule]][t] = seen[said[r.rule]].get(t, 0) + 1
    vocabulary = len(set(seen["block"]) | set(seen["allow"]))
    total = {c: sum(seen[c].values()) for c in seen}

    def odds(ts):
        x = np.log((docs["block"] + 1) / (docs["allow"] + 1))
        for t in ts:
            known = t in seen["block"] or t in seen["allow"]
            x += np.log((seen["block"].get(t, 0) + 1) / (total["block"] + vocabulary)) - np.log((seen["allow"].get(t, 0) + 1) / (total["allow"] + vocabulary)) if known or True else 0
        return x

    for r in rows:
        assert r.block_odds == pytest.approx(odds(tokens[r.page_id]), abs=1e-6)
        assert r.verdict == (said[r.rule] if r.rule else "block" if r.block_odds > 0 else "allow")


def test_judge_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "http://" + "ab" * 3000 + ".com/", "y")], "page_id int, url string, host string")
    none = urls.word_counts(df.limit(0), "url")
    rows = urls.judge(df, none).collect()
    assert len(rows) == 3 and {r.verdict for r in rows} == {"allow"} and all(r.rule is None for r in rows)
    assert urls.judge(df.limit(0), none).count() == 0 and none.count() == 0


def test_word_counts(spark):
    df = spark.createDataFrame([("<b>Ring</b> ring the the the x",), (None,), ("",)], "html string")
    assert {r.word: r.n for r in urls.word_counts(df, "html").collect()} == {"ring": 2, "the": 3}


def test_a_word_counted_once_splits_a_host(spark):
    texts = spark.createDataFrame([("ring ring the zyzzyva " + "q" * 21 + " other words",)], "html string")
    hosts = spark.createDataFrame([("thezyzzyvaring.a1-é.ring",), ("",), ("x",), ("q" * 30,)], "host string")
    got = {r.host: r.host_tokens for r in urls.host_words(hosts, urls.word_counts(texts, "html")).collect()}
    assert got["thezyzzyvaring.a1-é.ring"] == ["h:the", "h:zyzzyva", "h:ring", "h:a", "h:1", "h:é", "h:ring"]
    assert got[""] == [] and got["x"] == ["h:x"] and "".join(t[2:] for t in got["q" * 30]) == "q" * 30
    every = {r.word: r.n for r in urls.word_counts(texts, "html").collect()}
    assert all(t == urls.Segmenter(every).host(h) for h, t in got.items())
