import datetime as dt
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from brightloom.functions import sequences as sq
from brightloom.functions.sequences import chain, edit_distance, edit_map, lcs_length
from brightloom.operators import generation as gn, trajectories as tj

STEP = (
    "run_id string, agent string, step_no long, type string, ts timestamp, name string, arguments map<string,string>, "
    "content string, prompt_tokens int, completion_tokens int, model string"
)
CASE = "run_id string, expected_tools array<string>, reference_trajectory array<string>"
T0 = dt.datetime(2024, 1, 1)


def call(run, no, name, args=None, s=0.0):
    return (run, "a", no, "tool_call", T0 + dt.timedelta(seconds=s), name, args or {}, None, 0, 0, None)


def other(run, no, kind, content=None, tokens=(0, 0), model=None, s=0.0):
    return (run, "a", no, kind, T0 + dt.timedelta(seconds=s), None, None, content, *tokens, model)


def score(spark, steps, cases):
    return {r["run_id"]: r for r in tj.score_runs(spark.createDataFrame(steps, STEP), spark.createDataFrame(cases, CASE)).collect()}


def test_runs(spark):
    steps = [
        call("r", 2, "a", {"x": "1", "y": "2"}, 1.0), call("r", 1, "a", {"y": "2", "x": "1"}, 0.0), call("r", 3, "x", s=2.0), call("r", 4, "b", s=2.5),
        other("r", 5, "llm_call", tokens=(1000, 500), model="gpt-4o", s=3.0), other("r", 6, "final_answer", "first", s=4), other("r", 7, "final_answer", "last", s=4.5),
        other("idle", 1, "final_answer", "hi"),
    ]
    got = score(spark, steps, [("r", ["a", "b"], None), ("idle", [], None)])
    r, idle = got["r"], got["idle"]
    assert (r["final_answer"], r["wall_time_s"], r["total_tokens"]) == ("last", 4.5, 1500)
    assert r["cost_usd"] == pytest.approx(0.0075)
    assert (r["efficiency"], r["redundant_calls"], r["tool_order"]) == (0.5, 1, 0.5)
    assert (idle["tool_selection"], idle["tool_order"], idle["efficiency"], idle["wall_time_s"]) == (1.0, 1.0, 1.0, 0.0)


def test_efficiency_edges(spark):
    got = score(spark, [call("w", 1, "a"), other("n", 1, "final_answer", "x")], [("w", [], None), ("n", ["a"], None)])
    assert got["w"]["efficiency"] == 0.0 and got["n"]["efficiency"] == 0.0 and got["w"]["redundant_calls"] == 0


def test_selection(spark, one):
    parts = tj.selection_parts(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "abd")))
    row = spark.range(1).select(*[c.alias(n) for n, c in parts.items()]).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.6667, 0.6667, 0.6667)
    assert (row["missing"], row["unexpected"]) == (["c"], ["d"])


def test_unknown_model_has_the_fallback_price(spark):
    got = score(spark, [other("r", 1, "llm_call", tokens=(10**6, 10**6), model="mystery"), call("r", 2, "a")], [("r", ["a"], None)])
    assert got["r"]["cost_usd"] == pytest.approx(0.75)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_maps_compose():
    rng = random.Random(0)
    assert edit_map(list("abcd"), list("bad"))[0, -1] == 2 and edit_map(["a"], ["x", "a"])[0, -1] == 1
    for _ in range(60):
        a, b = rng.choices("abc", k=rng.randint(0, 6)), rng.choices("abc", k=rng.randint(1, 12))
        cut = rng.randint(0, len(b))
        assert chain([edit_map(a, b[:cut]), edit_map(a, b[cut:])]) == plain_distance(a, b) == edit_map(a, b)[0, -1] == edit_distance(a, b)


def test_long_and_wide_runs_take_the_exact_way(spark):
    rng = random.Random(2)
    seqs = {f"r{i}": rng.choices("abc", k=30 + 40 * i) for i in range(4)}
    seqs["wide"] = [f"tool{i}" for i in range(120)]
    steps = [call(r, i, n) for r, s in seqs.items() for i, n in enumerate(s)]
    reference = ["a", "b", "tool5", "c", "a"]
    df, cases = spark.createDataFrame(steps, STEP), spark.createDataFrame([(r, reference, None) for r in seqs], CASE)
    for limit in (10, 100, 10**6):
        got = {r["run_id"]: r["distance"] for r in tj.order_distance(df, cases, limit).collect()}
        assert got == {r: plain_distance(reference, s) for r, s in seqs.items()}


def test_agent_summary_and_gate(spark):
    steps = [x for i in range(4) for x in (call(f"r{i}", 1, "a", s=0), other(f"r{i}", 2, "final_answer", "ok", s=i + 1.0))]
    scored = tj.score_runs(spark.createDataFrame(steps, STEP), spark.createDataFrame([(f"r{i}", ["a"], None) for i in range(4)], CASE))
    summary = tj.agent_summary(scored)
    s = summary.first()
    assert s["latency_p50_s"] == 2.5 and s["latency_p95_s"] == pytest.approx(3.85) and s["tool_selection"] == 1.0 and s["runs"] == 4
    assert s["overall"] == pytest.approx((3 + s["cost_latency"]) / 4)
    tj.assert_agents_pass(summary, {"tool_selection": 1.0})
    with pytest.raises(tj.ThresholdsMissed, match="cost_latency"):
        tj.assert_agents_pass(summary, {"tool_selection": 0.5, "cost_latency": 0.99})
    with pytest.raises(KeyError):
        tj.gate_failures(summary, {"nope": 1.0})
    table = tj.comparison(summary, ["a"], ["tool_selection", "total_tokens"]).collect()
    assert {r["metric"]: r["a"] for r in table} == {"tool_selection": 1.0, "total_tokens": 0.0}


def test_lcs():
    rng = random.Random(1)
    assert lcs_length("the cat sat".split(), "the cat sat on the mat".split()) == 3 and lcs_length([], ["a"]) == 0
    for _ in range(80):
        a, b = rng.choices("abcd", k=rng.randint(1, 12)), rng.choices("abcd", k=rng.randint(1, 12))
        grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                grid[i + 1][j + 1] = grid[i][j] + 1 if x == y else max(grid[i][j + 1], grid[i + 1][j])
        assert lcs_length(a, b) == grid[-1][-1]


def test_rouge(spark):
    df = spark.createDataFrame([("the cat sat", "the cat sat on the mat"), ("", "x"), ("a", "b")], "p string, r string")
    rows = gn.rouge_l(df, "p", "r").collect()
    assert (rows[0]["rouge_l_precision"], rows[0]["rouge_l_recall"]) == (1.0, 0.5) and rows[0]["rouge_l_f1"] == pytest.approx(2 / 3)
    assert rows[1]["rouge_l_f1"] == rows[2]["rouge_l_f1"] == 0.0


def test_text_scores(one):
    p, r = F.col("p"), F.col("r")
    assert one(gn.exact_match(p, r), p="Restart the VPN!", r="restart the vpn") == 1.0
    assert one(gn.keyword_coverage(p, r), p="alpha beta gamma", r="alpha beta gamma delta omega") == 0.6
    assert one(gn.keyword_coverage(p, r), p="x", r="the of") == 0.0


def test_judge_and_answers(spark):
    rows = [("Paris is 21 degrees", "It is 21 degrees in paris."), ("Paris is 21 degrees", "no idea"), ("the", "anything"), ("Same Text", " same text ")]
    df = spark.createDataFrame(rows, "e string, a string")
    j = gn.keyword_judge(df, "e", "a").collect()
    assert [r["judge_score"] for r in j] == [1.0, 0.0, 1.0, 1.0]
    assert j[1]["judge_rationale"] == "Covered 0/3 reference keywords. Missing: paris, 21, degrees."
    s = gn.answer_scores(df, "e", "a").collect()
    assert s[3]["score"] == 1.0 and s[3]["exact"] and s[1]["score"] == 0.0 and s[0]["score"] == 1.0
    alike = lambda e, a: 1 - F.levenshtein(e, a) / F.greatest(F.length(e), F.length(a))
    both = gn.answer_scores(df, "e", "a", fuzzy=alike).collect()
    assert both[0]["score"] == pytest.approx(0.5 * both[0]["fuzzy"] + 0.5, abs=1e-4)
    only = gn.answer_scores(df, "e", "a", judge=None, fuzzy=alike).collect()
    assert only[0]["score"] == pytest.approx(only[0]["fuzzy"], abs=1e-4)
    assert gn.answer_scores(df, "e", "a", judge=None).collect()[0]["score"] == 0.0


def test_tuned_beats_base(spark):
    rows = [("1", "c", "restart the router", "turn it off", "restart the router now"), ("2", "d", "check the cable", "hm", "check cable")]
    df = spark.createDataFrame(rows, "id string, category string, reference string, base_output string, finetuned_output string")
    long = gn.unpivot_systems(df, {"base": "base_output", "finetuned": "finetuned_output"}, "id", "category", "reference")
    metrics = ["rouge_l_f1", "exact_match", "keyword_coverage"]
    delta = {r["metric"]: r["delta"] for r in gn.system_deltas(gn.system_scores(gn.score_outputs(long), metrics), metrics, "base", "finetuned").collect()}
    assert delta["rouge_l_f1"] > 0.5 and delta["keyword_coverage"] > 0.5 and delta["exact_match"] == 0.0


def test_matching_ratio_equals_a_quadratic_version():
    """Against the standard library, whose ratio the score is defined by."""
    rng = random.Random(11)
    pairs = [("", ""), ("a", ""), ("Straße", "STRASSE"), ("abcd", "bcde"), ("qabxcd", "abycdf"), ("x" * 300, "x" * 250), ("ab" * 150, "ba" * 150)]
    for n in (3, 30, 250):
        for _ in range(60):
            a = "".join(rng.choice("abcde  ") for _ in range(rng.randrange(n)))
            b = list(a) if rng.random() < 0.6 else [rng.choice("abcdef ") for _ in range(rng.randrange(n))]
            for _ in range(rng.randrange(1 + len(b) // 4)):
                b[rng.randrange(len(b))] = rng.choice(["", "z", "ab", " "])
            pairs.append((a, "".join(b)))
    for a, b in pairs:
        assert sq.matching_ratio(a, b) == pytest.approx(SequenceMatcher(None, a.casefold(), b.casefold()).ratio()), (a, b)


def test_answer_correctness_blends_the_ratio(spark):
    df = spark.createDataFrame([("Paris is big", "paris is BIG "), ("the red fox", "a red ox"), ("", ""), (None, "x")], "e string, a string")
    rows = gn.answer_scores(df, "e", "a", judge=None, fuzzy=gn.sequence_ratio).collect()
    assert [r["exact"] for r in rows[:3]] == [True, False, False]
    assert rows[1]["score"] == pytest.approx(round(SequenceMatcher(None, "the red fox", "a red ox").ratio(), 4))
    assert rows[2]["score"] == 1.0 and rows[3]["fuzzy"] == 0.0
