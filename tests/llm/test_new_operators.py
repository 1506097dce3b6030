"""Fill-in-the-middle, MinHash near-duplicates and ranked search against plain versions."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from brightloom.llm import fim, minhash, nra
from brightloom.llm.common import Workspace, picked
from brightloom.llm.jaccard import shingles

UNITS = {"words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "lines": r"[^\n]*\n|[^\n]+"}
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ODD = [
    None, "", " ", "\n", "a", " a", "a ", "ab cd", "é", "é ", "  é\x1c b", "日本 語\n\nx", "x" * 5000, "w " * 3000, "one <P> mark",
    "a<", "<S", "S> b", "tail\t", "😀 😀a", "a\x0bb\x0cc\rd",
]


def test_columns_are_picked_by_exact_name(spark):
    df = spark.createDataFrame([(1, "a", "b", 2, "c")], "Doc_ID int, TEXT string, text string, doc_id int, text2 string")
    assert picked(df, doc_id="doc_id", text="text").collect() == [(2, "b")]
    assert picked(spark.createDataFrame([(1, 2)], "Doc_ID int, x int"), doc_id="doc_id").collect() == [(1,)]


def test_a_workspace_goes_also_on_failure(spark, tmp_path):
    with pytest.raises(ZeroDivisionError), Workspace(spark, "w") as tables:
        assert tables.stored(spark.range(3), "t").count() == 3
        raise ZeroDivisionError
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(tables.folder)


# --- fill in the middle -------------------------------------------------------

def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 8, 777).astype(np.uint8)
    matrix, at = fim.WaveletMatrix(codes, 3), np.arange(778)
    for code in range(8):
        assert (matrix.rank(code, at) == np.append(0, np.cumsum(codes == code))).all()
    low, high = np.zeros(300, np.int64), np.full(300, 777)
    places, ends = matrix.reach((2, 5), np.arange(300), low, high), np.flatnonzero(np.isin(codes, (2, 5))) + 1
    assert (places == [0, *ends, *[777] * 300][: 300]).all()


def plain_fim(row, text, unit):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    h = hashlib.sha256(f"42:{'' if row is None else row}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:one]), "".join(units[one:two]), "".join(units[two:])
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit", ["words", "lines"])
def test_fim_equals_plain_version(spark, unit):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab é\n\t😀<PS>M") for _ in range(rng.randrange(60))) for _ in range(600)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id here", "x"), (3, "same id", "x"), (3, "same id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, TEXT2 string").repartition(3)
    made = fim.transform(df, unit=unit).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = collections.Counter((i, *plain_fim(i, t, unit), t or "") for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made) == want
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_fim_of_odd_tables(spark, monkeypatch):
    df = spark.createDataFrame([("k1", "some words in here", 1), ("k2", None, 2)], "doc_id string, text string, TEXT int")
    whole = sorted(fim.transform(df).collect())
    assert [r.doc_id for r in whole] == ["k1", "k2"] and fim.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no unit"):
        fim.transform(df, unit="pages")


def test_fim_parts_of_any_size():
    texts = ["a b", "", None, "x" * 50, "c"]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    before, fim.PART_BYTES = fim.PART_BYTES, 8
    try:
        parts = list(fim._parts(iter([batch.slice(0, 2), batch.slice(2)])))
    finally:
        fim.PART_BYTES = before
    assert b"".join(d.tobytes() for _, d, _ in parts) == "".join(t or "" for t in texts).encode()
    assert sum(p.num_rows for p, _, _ in parts) == 5 and max(len(e) for _, _, e in parts) == 3


# --- MinHash --------------------------------------------------------------------

def test_distance_and_keys(spark):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 64, 300, np.uint64)) for _ in range(2)]
    sets += [np.concatenate([sets[0][k:], sets[1][:k]]) for k in (5, 20, 45, 120)]
    signed = minhash.signatures(sets)
    nodes = spark.createDataFrame([(i, *map(int, s)) for i, s in enumerate(signed)], "node long, " + ", ".join(f"c{i} long" for i in range(8)))
    places = signed.view(np.uint8).reshape(len(sets), 8, 8)[:, :, :6].reshape(len(sets), 48)
    pairs = minhash._named(nodes, "a").join(minhash._named(nodes, "b"), F.col("a") < F.col("b"))
    rows = pairs.select("a", "b", minhash.distance().alias("d"), *[minhash.first_chunk(F.lit(j)).alias(f"f{j}") for j in range(8)]).collect()
    got, first = {(r.a, r.b): r.d for r in rows}, {(r.a, r.b): [r[f"f{j}"] for j in range(8)] for r in rows}
    assert got == {(a, b): int((places[a] != places[b]).sum()) for a, b in got}
    keys = collections.defaultdict(set)
    for r in minhash.index_keys(nodes).collect():
        keys[r.node].add(r.key)
    assert all(len(k) == 48 for k in keys.values())
    for (a, b), d in got.items():  # they meet exactly when some chunk differs in one place at most
        chunks = (places[a] != places[b]).reshape(8, 6).sum(1)
        assert bool(keys[a] & keys[b]) == bool((chunks <= 1).any())
        assert d > minhash.GUARANTEED or keys[a] & keys[b]
        assert first[(a, b)] == [not (chunks[:j] <= 1).any() for j in range(8)]


def test_odd_sketches_never_hide_a_link():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in (1, 7, 300, 5000)] + [np.zeros(0, np.uint64)]
    sets += [np.unique(np.concatenate([sets[2][k:], sets[3][:k]])) for k in (1, 30, 200)]
    words = minhash.odd_sketches(sets, minhash.SKETCH_WORDS)
    assert words.shape == (len(sets), minhash.SKETCH_WORDS) and not words[4].any()
    for i in range(len(sets)):
        for j in range(i):
            bits = int(np.bitwise_count((words[i] ^ words[j]).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(sets[i], sets[j])) and (len(np.setxor1d(sets[i], sets[j])) > 60 or bits > 0)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 1 << 64, 400, np.uint64)) for _ in range(200)]
    near = [np.concatenate([s[30:], np.unique(rng.integers(0, 1 << 64, 30, np.uint64))]) for s in base]
    a, b = (minhash.signatures(x).view(np.uint8).reshape(200, 8, 8)[:, :, :6] for x in (base, near))
    expected = 48 * (1 - 370 / 430) * 255 / 256
    assert (a != b).sum((1, 2)).mean() == pytest.approx(expected, abs=0.6)


def near_texts(seed):
    """Families of near copies: chains, hubs whose members do not link with each other, exact copies, odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(12):
        words = [word() for _ in range(120)]
        for _ in range(8):  # a chain: each differs from the one before by one word
            texts.append(" ".join(words))
            words[rng.randrange(120)] = word()
        hub = [word() for _ in range(150)]
        for _ in range(10):  # each differs from the hub by two words, from each other by four
            copy = list(hub)
            for at in rng.sample(range(150), 2):
                copy[at] = word()
            texts.append(" ".join(copy))
        texts += [" ".join(hub)] * 3 + [" ".join(hub).upper()]
    texts += [" ".join(word() for _ in range(n)) for n in (1, 2, 4, 5, 6, 7, 9, 15) for _ in range(4)]
    texts += ["a b c d e f g h i j", "a b c d e f g h i j k", "w " * 50, "w " * 60, "one two", "one two", "", None, " \n", "x" * 3000]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,width,percent", [(1, 5, 85), (2, 3, 90), (3, 5, 80)])
def test_near_copies_equal_brute_force(spark, seed, width, percent):
    rows = list(enumerate(near_texts(seed)))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, NODE int, TEXT int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.classify(df, width, percent).collect()}
    want = brute.jaccard_components(rows, width, percent)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_near_copies_without_ids_and_of_nothing(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    other = [*words[:100], "changed", *words[101:]]
    third = [*other[:50], "again", *other[51:]]
    rows = [(5, " ".join(words)), (None, " ".join(other)), (9, " ".join(third)), (None, "nothing like it"), (None, None), (7, None), (7, None), (9, "same id, other text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in minhash.classify(df, 5, 90).collect())
    assert got == collections.Counter([
        (5, 5, True), (None, 5, False), (9, 5, False), (None, None, True), (None, None, True), (7, 7, True), (7, 7, True), (9, 9, True),
    ])
    assert minhash.classify(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="80 %"):
        minhash.classify(df, percent=70)


# --- ranked search --------------------------------------------------------------

def plain_search(docs, items, k):
    lowered = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    held = [(i, collections.Counter(re.findall(TERM, lowered(t)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(s for _, _, s in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out, wanted = [], collections.defaultdict(set)
    for item, text in items:
        wanted[item] |= set(re.findall(TERM, lowered(text)))
    for item, found in wanted.items():
        scored = []
        for i, c, size in held:
            m = 100 - 90 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in found if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(out, key=str)


def ranked(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def search_case(seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdéfg" for b in "xyzXYZ0"]
    text = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.08)), len(vocabulary) - 1)] for _ in range(n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(None, docs[3][1]), (2000, None), (2001, ""), (2002, "?! ..."), (2003, text(4000))]
    items = [(i, text(rng.randrange(1, 12))) for i in range(15)] + [(50, docs[3][1]), (51, None), (52, "unheard-of"), (3, "ax by"), (None, "AX cz")]
    return docs, items


@pytest.mark.parametrize("seed,k,shard", [(1, 10, 64), (2, 3, 1 << 14), (3, 1000, 100)])
def test_search_equals_scoring_everything(spark, monkeypatch, seed, k, shard):
    docs, items = search_case(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, TEXT int").repartition(3)
    asked = spark.createDataFrame(items, "item_id int, text string")
    monkeypatch.setattr(nra, "SHARD_DOCS", shard)
    assert ranked(nra.search(df, asked, k)) == plain_search(docs, items, k)


def test_items_in_blocks(spark, monkeypatch):
    docs, items = search_case(4)
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    monkeypatch.setattr(nra, "BLOCK_TERMS", 40)
    assert ranked(nra.search(df, asked, 5)) == plain_search(docs, items, 5)


def test_search_of_nothing(spark):
    df, asked = spark.createDataFrame([("a", "x y")], "doc_id string, text string"), spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert nra.search(df.limit(0), asked).count() == 0 and nra.search(df, asked.limit(0)).count() == 0
    assert [tuple(r) for r in nra.search(df, asked).collect()] == [(1, 1, "a", math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 800)))]


def test_reads_stop_early_and_ties_stay_whole():
    rng = np.random.default_rng(7)
    size, lists = 5000, []
    for df in (5000, 4000, 800, 30, 6):
        share = np.sort(rng.integers(1, 5_000_000 // df, df))[::-1].copy()
        share[:6] = share[0]
        held = rng.permutation(np.arange(6, size))[: df - 6]
        lists.append((np.concatenate([np.arange(6), held]), share))
    lists[-1][1][:] = 10_000_000  # documents 0 to 5 tie under a rare term and lead all lists
    scores = np.zeros(size, np.int64)
    for docs, share in lists:
        scores[docs] += share
    found, got, read = nra.nra(lists, size, 3, 0)
    assert (got == scores[found]).all() and set(np.argsort(-scores)[:3]) <= set(found)
    assert read < sum(len(d) for d, _ in lists)
    assert not len(nra.nra(lists, size, 3, int(scores.max()) + 1)[0])
    assert shingles("a b c d e f", 5).shape == (2,)
