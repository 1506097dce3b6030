"""Mixing, sharding, fingerprints, exact copies, chat formatting and the n-gram join against plain versions."""

import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

import brute
from brightloom.llm import chat, components, exact_dedup, jaccard, mixing, sharding, sketches
from brightloom.llm.common import most_frequent, stored

DOCS = "doc_id long, text string, source string, Extra int"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# --- mixing -----------------------------------------------------------------

@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, "d": 7, None: 3}, {"a": 0, "b": 10}, {"é": 5, "z": 5, "A": 90},
    {"a": 0}, {"x": 1, "y": 1, "z": 10_000, "é": 10}, {None: 4},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_rates(df).collect()}
    assert got == pytest.approx(brute.targets(sizes))


def test_mix_emits_what_the_plan_says(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(0, 9)), rng.choice(["a", "b", "c", None]), i) for i in range(300)]
    rows += [(1, "w w", "a", 1), (1, "w w", "a", 1), (400, None, "a", 0), (401, "", None, 0), (None, "w", "b", 0)]
    df = spark.createDataFrame(rows, DOCS)
    plan = mixing.mix_plan(df).collect()
    assert len(plan) == len(rows)
    copies = {}
    for r in plan:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    out = mixing.mix(df)
    assert out.columns == df.columns
    counted = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counted == {i: n for i, n in copies.items() if n}
    assert rows_of(out, "doc_id", "text") == rows_of(mixing.mix(df), "doc_id", "text")
    assert mixing.mix(df.limit(0)).count() == mixing.mix_plan(df.limit(0)).count() == 0


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 3}", 0) for i in range(6000)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, DOCS)).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert all(r.taken == pytest.approx(r.target, rel=0.05) for r in plan)


# --- sharding ---------------------------------------------------------------

def shards(rows, limit):
    """Split the whole hash range bit by bit."""
    key = lambda r: int(hashlib.md5(f"{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
    out = {}

    def split(members, depth, bits):
        size = sum(len((r[1] or "").encode()) for _, r in members)
        if size <= limit or len(members) == 1 or depth == 60:
            for n, _ in members:
                out[n] = (bits, depth, size, len(members), size <= limit)
            return
        for side in (0, 1):
            half = [m for m in members if key(m[1]) >> (59 - depth) & 1 == side]
            if half:
                split(half, depth + 1, bits + str(side))

    if rows:
        split(list(enumerate(rows)), 0, "")
    return sorted((str(rows[n][0]), *v) for n, v in out.items())


@pytest.mark.parametrize("limit", [40, 300, 10**6])
def test_shards(spark, limit):
    rng = random.Random(4)
    rows = [(i, "é" * rng.randrange(0, 30), "s", 0) for i in range(200)]
    rows += [(500, "x" * 1000, "s", 0), (501, None, "s", 0), (None, "y" * 9, "s", 0)] + [(7, "same " * 10, "s", 0)] * 3
    got = sharding.assign(spark.createDataFrame(rows, DOCS), limit).collect()
    assert sorted((str(r.doc_id), r.shard, r.depth, r.shard_bytes, r.shard_rows, r.fits) for r in got) == shards(rows, limit)


def test_shards_of_nothing(spark):
    assert sharding.assign(spark.createDataFrame([], DOCS), 10).count() == 0


# --- fingerprints -----------------------------------------------------------

def kept(text):
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    chain = lambda value, seed: xxhash.xxh64_intdigest(struct.pack("<q", signed(value)), seed=seed % (1 << 64))
    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.findall(brute.WORD, text)]
    found = []
    for i in range(len(words) - 4):
        value = 42
        for k in range(5):
            value = chain(words[i + k], value)
        found.append(signed(value))
    if 0 < len(words) < 5:
        value = 0
        for w in words:
            value = signed(chain(w, chain(value, 42)))
        found.append(value)
    low = sorted({h for h in found if h < -(1 << 63) + (1 << 64) // sketches.SCALE})
    return low or [min(found)] if found else []


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(sketches, "SLICE_ROWS", 10)
    rng = random.Random(6)
    rows = [(i * i * 1000 - 50_000, " ".join(rng.choice("abcdefgh é日") for _ in range(rng.randrange(0, 120))), "s", 0) for i in range(150)]
    rows += [(3, None, "s", 0), (5, "", "s", 0), (7, "dup text", "s", 0), (7, "dup text", "s", 0), (7, "other", "s", 0), (None, "no id", "s", 0), (1 << 62, "far", "s", 0)]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for (i, text, *_), (_, following, *_) in zip(order, order[1:] + order[:1], strict=True):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = set(kept(text)), set(kept(edited)), set(kept(following))
        alike = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        hexed = lambda x: "".join(f"{h % (1 << 64):016X}" for h in sorted(x))
        want.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), alike(a, b), alike(a, c)))
    got = sketches.fingerprints(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r[0]), *r[1:7]) for r in got) == sorted(want)


def test_fingerprints_of_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "a b c d e f", "s", 0)], DOCS)
    row = sketches.fingerprints(one).first()
    assert row.near_next == 1.0 and row.n_chars == 11
    assert sketches.fingerprints(one.limit(0)).count() == 0


def test_merged_and_containment(spark):
    rng = random.Random(8)
    a, b = (" ".join(str(rng.randrange(1000)) for _ in range(200)) for _ in range(2))
    row = spark.createDataFrame([(a, b, a + " | " + b)], "a string, b string, ab string").select(
        sketches.hashes(F.col("a")).alias("a"), sketches.hashes(F.col("b")).alias("b"), sketches.hashes(F.col("ab")).alias("ab")
    ).select(sketches.merged(F.col("a"), F.col("b")).alias("m"), "a", "b", "ab", sketches.containment(F.col("a"), F.col("ab")).alias("c")).first()
    assert sorted(set(row.a) | set(row.b)) == row.m and set(row.m) <= set(row.ab) and row.c == 1.0


# --- exact copies -----------------------------------------------------------

COPIES = [
    (1, "Same", "s", 0), (2, "sAME", "s", 0), (9, "same", "s", 0), (3, "É", "s", 0), (4, "é", "s", 0), (5, None, "s", 0), (6, "", "s", 0),
    (7, "alone", "s", 0), (8, "twice", "s", 1), (8, "twice", "s", 1), (None, "alone", "s", 0), (None, "lost", "s", 0), (10, "x" * 100_000, "s", 0),
]


def grouped(rows):
    groups = {}
    for r in rows:
        groups.setdefault(brute.lowered(r[1]), []).append(r[0])
    out = []
    for r in rows:
        ids = groups[brute.lowered(r[1])]
        out.append((r[0], max((i for i in ids if i is not None), default=None), len(ids)))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.lit(b"x"), lambda text: F.substring(F.md5(text.cast("binary")), 1, 1).cast("binary")])
def test_copies_even_where_digests_clash(spark, digest):
    found = exact_dedup.classify(spark.createDataFrame(COPIES, DOCS), digest=digest)
    assert rows_of(found, "doc_id", "keep_id", "group_size") == grouped(COPIES)
    per_group = found.where("kept").groupBy("keep_id").count().collect()
    assert found.where("kept").count() == len({brute.lowered(r[1]) for r in COPIES}) and all(r["count"] == 1 for r in per_group)


def test_state_goes_on_with_new_files(spark):
    from brightloom.llm.common import fresh_path

    keys, folder = fresh_path(spark, "keys"), fresh_path(spark, "state")
    state = exact_dedup.DigestState(spark, folder)
    place = F.struct(F.lit("f").alias("file"), F.col("doc_id").alias("row"))
    for part in ([(1, "a"), (2, "b")], [(5, "a"), (3, "c")]):
        df = spark.createDataFrame(part, "doc_id long, text string")
        df.select(exact_dedup.sha256(F.col("text")).alias("digest"), "doc_id", place.alias("locator")).write.mode("append").parquet(keys)
        state.absorb(keys)
    assert sorted((r.keep_id, r.group_size) for r in exact_dedup.DigestState(spark, folder).entries().collect()) == [(2, 1), (3, 1), (5, 2)]


def test_drop_copies(spark):
    df = spark.createDataFrame(COPIES, DOCS)
    out = exact_dedup.drop_copies(stored(df, "docs"))
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["9", "3", "4", "6", "7", "8", "None", "10"])
    assert exact_dedup.drop_copies(df.limit(0)).count() == 0


# --- chat -------------------------------------------------------------------

NASTY = ["", "</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>\n", "<\\|end|>", "<\\\\|end|><|end|>", "<<SYS>><s>", "a\\<b [x]", "<|end|>" * 3, "é\n\n", "[\\INST][INST]"]


def test_turns_come_back(spark):
    turns = [(i, [(role, text) for role in ("user", "assistant", "a\n%0A<|end|>", "")]) for i, text in enumerate(NASTY)] + [(99, [])]
    df = spark.createDataFrame(turns, "id int, turns array<struct<role:string,text:string>>")
    for r in df.select("turns", chat.format_turns(F.col("turns")).alias("f")).withColumn("back", chat.parse_turns(F.col("f"))).collect():
        assert r.back == r.turns and r.f.count("<|turn|>") == r.f.count("<|end|>") == len(r.turns)
        for other in set(chat.CONTROL) - {chat.START, chat.END}:
            assert other not in r.f


MIXED = [
    ('{"id": 1, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": null}]}', "messages", [("user", "hi"), ("assistant", "")]),
    ('{"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "s"}', "conversations", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ('{"id": 3, "instruction": "do", "input": "this", "output": "done"}', "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ('{"id": 4, "instruction": "do", "output": "done"}', "instruction", [("user", "do"), ("assistant", "done")]),
    ('{"id": 5, "prompt": "p", "completion": "c"}', "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ('{"id": 6, "prompt": "p", "response": "r"}', "prompt_response", [("user", "p"), ("assistant", "r")]),
    ('{"id": 7, "question": "q", "answer": "a", "context": "c"}', "question_answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ('{"id": 8, "prompt": "p"}', None, None),
    ('{"id": 9}', None, None),
    ('{"id": 10, "messages": []}', "messages", []),
]


def test_layouts(spark, tmp_path):
    path = tmp_path / "mixed.jsonl"
    path.write_text("\n".join(x for x, _, _ in MIXED))
    records = spark.read.json(str(path))
    fields = [c for c in records.columns if c != "id"]
    got = {r.id: r for r in chat.format_records(records, fields).collect()}
    for n, (_, layout, turns) in enumerate(MIXED, 1):
        r = got[n]
        assert r.layout == layout and (r.turns if turns is None else [tuple(t) for t in r.turns]) == turns
        assert (r.formatted is None) == (turns is None) and len(r.layout_fingerprint) == 32
        if turns:
            assert r.loss_mask == [role == "assistant" for role, _ in turns]
    assert got[3].layout_fingerprint != got[4].layout_fingerprint
    assert chat.format_records(records.limit(0), fields).count() == 0


def test_gather(spark):
    rows = spark.createDataFrame([(1, 2, "a", None), (1, 1, "u", "x"), (1, 1, "u", "x"), (None, None, None, "z")], "c int, t int, r string, x string")
    got = {r.c: [tuple(m) for m in r.messages] for r in chat.gather(rows, "c", "t", "r", "x").collect()}
    assert got == {1: [("u", "x"), ("u", "x"), ("a", "")], None: [("", "z")]}


# --- n-gram join ------------------------------------------------------------

def families(rng, n):
    """Near copies of a few texts, passages that many texts share, and short texts."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    text = lambda k: [word() for _ in range(k)]
    seeds, passage, rows = [text(120), text(60), text(300)], text(58), []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4:
            t = list(rng.choice(seeds))
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = word()
            t = t[: len(t) - rng.randrange(0, 12)]
        elif kind < 0.7:
            t = text(rng.randrange(0, 30)) + passage + text(rng.randrange(0, 12))
        else:
            t = text(rng.randrange(0, 8))
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(t), "s", 0))
    return rows


@pytest.mark.parametrize("width, percent, span", [(4, 85, 4096), (5, 80, 3), (1, 60, 8)])
def test_components_equal_brute_force(spark, monkeypatch, width, percent, span):
    monkeypatch.setattr(jaccard, "PIVOT_SPAN", span)
    monkeypatch.setattr(jaccard, "ORDER_MIN", 3)
    rows = families(random.Random(width), 250) + [(900, None, "s", 0), (901, "", "s", 0), (902, " \n", "s", 0), (903, "One two", "s", 0), (904, "one TWO", "s", 0)]
    got = jaccard.classify(spark.createDataFrame(rows, DOCS), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard_components([r[:2] for r in rows], width, percent)


@pytest.fixture
def tables(monkeypatch):
    """The tables that a run of the join writes: (label, table)."""
    seen = []
    monkeypatch.setattr(jaccard, "stored", lambda df, label: seen.append((label, stored(df, label))) or seen[-1][1])
    return seen


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_forced_rounds_and_short_starts_equal_brute_force(spark, monkeypatch, tables, width, percent):
    monkeypatch.setattr(jaccard, "ORDER_MIN", 3)
    monkeypatch.setattr(jaccard, "PAIRS_A_POSTING", -1)
    monkeypatch.setattr(jaccard, "SPARE", 0)
    rows = families(random.Random(width), 200)
    got = jaccard.classify(spark.createDataFrame(rows, DOCS), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard_components([r[:2] for r in rows], width, percent)
    assert [label for label, _ in tables].count("labelled") == 1 + jaccard.MERGE_ROUNDS
    again = next(t.count() for label, t in tables if label == "again")
    assert 0 < again < len(rows)  # texts cut into n-grams a second time: only those that begin with frequent ones


def test_even_tables_need_no_round(spark, tables):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(80)) for _ in range(60)]
    rows = [(i, t, "s", 0) for i, t in enumerate(texts + [t + " more" for t in texts[:20]])]
    got = jaccard.classify(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard_components([r[:2] for r in rows], 4, 85)
    assert [label for label, _ in tables].count("labelled") == 1
    assert next(t.count() for label, t in tables if label == "again") == 0


def test_few_links_make_few_files(spark, monkeypatch):
    """With 211 shuffle partitions a round over a handful of links wrote as many files."""
    kept, before = [], {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = spark.createDataFrame([(i, i + 1) for i in range(0, 90) if i % 10], "a long, b long")
        root = components.components(links, keep=lambda df, label: kept.append(stored(df, label)) or kept[-1])
        assert {r.node: r.root for r in root.collect()} == {i: (i - 1) // 10 * 10 + 1 for i in range(1, 91)}
        assert max(len(t.inputFiles()) for t in kept[1:]) == 1
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_join_edges(spark):
    rows = [(5, "a b c d e f", "s", 0), (5, "a b c d e f", "s", 0), (None, "a b c d e f", "s", 0), (2, "x y", "s", 0), (None, None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    assert rows_of(jaccard.classify(df), "doc_id", "n_shingles", "component_id") == sorted([(5, 3, 5), (5, 3, 5), (None, 3, 5), (2, 1, 2), (None, 0, None)], key=str)
    kept_rows = jaccard.keep_one(df)
    assert kept_rows.columns == df.columns and kept_rows.count() == 5
    assert jaccard.classify(df.limit(0)).count() == jaccard.keep_one(df.limit(0)).count() == 0


def test_near_copies_without_id(spark):
    words = [f"w{i}" for i in range(300)]
    text = lambda low, high: " ".join(words[low:high])
    rows = [
        (1, text(0, 103)), (None, text(0, 111)), (2, text(0, 125)),  # 1 and 2 link only by the row between them
        (7, text(150, 250)), (None, text(150, 252)), (None, text(150, 252)),
        (None, text(252, 290)), (None, text(252, 291)),
    ]
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], DOCS)
    assert rows_of(jaccard.classify(df), "doc_id", "n_shingles", "component_id") == sorted([
        (1, 100, 1), (None, 108, 1), (2, 122, 1), (7, 97, 7), (None, 99, 7), (None, 99, 7), (None, 35, None), (None, 36, None),
    ], key=str)


def test_words_hash_alike_wherever_they_stand():
    seen = {}
    text = " ".join(["alpha", "x" * 64, "x" * 65, "x" * 300, "é", "b"] * 3)
    for w, h in zip(text.split(), jaccard.word_hashes(text).tolist(), strict=True):
        assert seen.setdefault(w, h) == h == jaccard.word_hashes(w.upper() if w.isascii() else w)[0]
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (9, 8), (7, 7), (20, 10), (20, 30), (30, 40), (40, 50), (50, 60), (60, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, **{i: 5 for i in (5, 10, 20, 30, 40, 50, 60)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_most_frequent(spark):
    df = spark.createDataFrame([("a", 100), ("b", 90), ("c", 10), ("d", 10), ("e", 1)], "w string, n long")
    assert sorted(r.w for r in most_frequent(df, 3).collect()) == ["a", "b"]
    assert most_frequent(df, 5).count() == 5 and most_frequent(df, 0).count() == 0 and most_frequent(df.limit(0), 3).count() == 0
