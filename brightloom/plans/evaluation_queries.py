"""Registered run and text evaluation queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightloom.functions import fixed, text as tx
from brightloom.operators import generation as gn, trajectories as tj
from brightloom.plans.bindings import AGENTS, CASES_SQL, MODELS, PAIRS_SQL, STEPS_SQL, conversation_pairs, run_cases, run_steps
from brightloom.plans.text_queries import snippet_sql, strip_sql, tokens_sql, words_sql
from brightloom.session import materialised

SYSTEMS = {"base": "base_output", "finetuned": "finetuned_output"}
THRESHOLDS = {"tool_selection": 0.6, "tool_order": 0.4, "efficiency": 0.9}
ROWS = [*tj.METRICS, "overall", "total_cost_usd", "total_tokens", "latency_p50_s", "latency_p95_s"]


def trajectories(spark, sf):
    return tj.run_summary(run_steps(spark, sf)).select(
        "run_id", "agent", "n_steps", "n_calls", F.array_join("tools", ",").alias("tools"), "prompt_tokens",
        "completion_tokens", F.round("wall_time_s", 3).alias("wall_time_s"), "final_answer",
    )


def tool_sequences(spark, sf):
    return tj.tool_calls(run_steps(spark, sf))


def tool_selection(spark, sf):
    steps = run_steps(spark, sf)
    runs = tj.run_summary(steps).join(run_cases(steps), "run_id")
    parts = tj.selection_parts(F.col("expected_tools"), F.col("tools"))
    out = runs.select("run_id", *[c.alias(n) for n, c in parts.items()])
    return out.withColumns({n: F.array_join(n, ",") for n in ("missing", "unexpected")})


def _scored(spark, sf):
    """One table per run; the steps are written once, as every score reads them."""
    steps = materialised(run_steps(spark, sf), "steps")
    return tj.score_runs(steps, run_cases(steps))


def tool_order(spark, sf):
    return _scored(spark, sf).select("run_id", F.col("distance").alias("edit_distance"), "tool_order")


def efficiency(spark, sf):
    return _scored(spark, sf).select("run_id", F.col("n_reference"), "n_calls", "redundant_calls", "efficiency")


def run_cost(spark, sf):
    return tj.run_summary(run_steps(spark, sf)).select("run_id", F.round("cost_usd", 8).alias("cost_usd"), "total_tokens")


def cost_latency(spark, sf):
    return _scored(spark, sf).select("run_id", "cost_latency")


def _summary(spark, sf):
    return tj.agent_summary(materialised(_scored(spark, sf), "runs"))


def agent_summary(spark, sf):
    return _summary(spark, sf).withColumn("overall", F.round("overall", 6))


def agent_comparison(spark, sf):
    out = tj.comparison(_summary(spark, sf), AGENTS, ROWS)
    return out.withColumns({a: F.round(a, 6) for a in AGENTS})


def gate_failures(spark, sf):
    return tj.gate_failures(_summary(spark, sf), THRESHOLDS)


def _answers(spark, sf):
    return conversation_pairs(spark, sf).select(
        "conv_id", "turn", F.col("reply").alias("expected"),
        F.substring("reply", F.lit(1), F.ceil(F.length("reply") / 2).cast("int")).alias("actual"),
    )


def answer_scores(spark, sf):
    out = gn.answer_scores(_answers(spark, sf), "expected", "actual")
    return out.select("conv_id", "turn", "exact", "judge_score", "score")


def answer_correctness(spark, sf):
    """The whole answer score: the judge and the ratio of matching blocks, halves of it."""
    out = gn.answer_scores(_answers(spark, sf), "expected", "actual", fuzzy=gn.sequence_ratio)
    return out.select("conv_id", "turn", "exact", "judge_score", F.round("fuzzy", 4).alias("fuzzy"), "score")


def judge_scores(spark, sf):
    out = gn.keyword_judge(_answers(spark, sf), "expected", "actual")
    return out.select("conv_id", "turn", F.col("judge_score").alias("score"), F.col("judge_rationale").alias("rationale"))


def _pairs(spark, sf):
    return conversation_pairs(spark, sf).select(
        "conv_id", "turn", F.concat(F.lit("turn_"), F.col("turn").cast("string")).alias("category"),
        F.col("prompt").alias("base_output"), tx.snippet(F.col("reply"), 3).alias("finetuned_output"),
        F.col("reply").alias("reference"),
    )


def _outputs(spark, sf):
    return gn.unpivot_systems(_pairs(spark, sf), SYSTEMS, "conv_id", "turn", "category", "reference")


def rouge_l(spark, sf):
    out = gn.rouge_l(_outputs(spark, sf), "output", "reference")
    return out.select("conv_id", "turn", "system", *[F.round(f"rouge_l_{m}", 6).alias(m) for m in ("precision", "recall", "f1")])


def exact_match(spark, sf):
    return _outputs(spark, sf).select("conv_id", "turn", "system", gn.exact_match(F.col("output"), F.col("reference")).alias("exact_match"))


def keyword_coverage(spark, sf):
    c = gn.keyword_coverage(F.col("output"), F.col("reference"))
    return _outputs(spark, sf).select("conv_id", "turn", "system", F.round(c, 6).alias("keyword_coverage"))


_PLAIN = ["exact_match", "keyword_coverage"]


def system_scores(spark, sf):
    scored = gn.score_outputs(_outputs(spark, sf), with_rouge=False)
    out = gn.system_scores(scored, _PLAIN, "category")
    return out.withColumns({m: F.round(m, 6) for m in _PLAIN})


def system_deltas(spark, sf):
    scored = gn.score_outputs(_outputs(spark, sf), with_rouge=False)
    out = gn.system_deltas(gn.system_scores(scored, _PLAIN), _PLAIN, "base", "finetuned")
    return out.withColumns({m: F.round(m, 6) for m in ("base", "tuned", "delta")})


def system_report(spark, sf):
    """Per category and metric, ROUGE-L included."""
    metrics = ["rouge_l_f1", *_PLAIN]
    scored = gn.score_outputs(_outputs(spark, sf))
    return gn.system_deltas(gn.system_scores(scored, metrics, "category"), metrics, "base", "finetuned", "category")


QUERIES = {
    f.__name__: f
    for f in (
        trajectories, tool_sequences, tool_selection, tool_order, efficiency, run_cost, cost_latency, agent_summary,
        agent_comparison, gate_failures, answer_scores, answer_correctness, judge_scores, rouge_l, exact_match, keyword_coverage,
        system_scores, system_deltas, system_report,
    )
}

# --- oracles ---------------------------------------------------------------------------

_CODE = "list_aggregate(list_transform({0}, lambda t: CASE t WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' ELSE 'p' END), 'string_agg', '')"
_P = {m: fixed.MODEL_PRICES.get(m, fixed.MODEL_PRICES[fixed.FALLBACK_MODEL]) for m in MODELS}
_PRICE = lambda i: "CASE model " + " ".join(f"WHEN '{m}' THEN {p[i]}::DOUBLE" for m, p in _P.items()) + " END"
_RUNS = f"""
steps AS ({STEPS_SQL}), cases AS ({CASES_SQL}),
runs AS (SELECT run_id, any_value(agent) AS agent, count(*) AS n_steps, count(*) FILTER (type = 'tool_call') AS n_calls,
  coalesce(list_sort(list(DISTINCT name) FILTER (type = 'tool_call')), []) AS tools,
  coalesce(list(name ORDER BY step_no) FILTER (type = 'tool_call'), []) AS seq,
  sum(pt)::BIGINT AS pt, sum(ct)::BIGINT AS ct, (arg_max(us, step_no) - arg_min(us, step_no)) / 1e6 AS wall,
  coalesce(arg_max(props, step_no) FILTER (type = 'final_answer'), '') AS final_answer,
  count(DISTINCT (name, k % 5)) FILTER (type = 'tool_call') AS n_distinct,
  coalesce(sum(pt / 1e6 * {_PRICE(0)} + ct / 1e6 * {_PRICE(1)}) FILTER (type = 'llm_call'), 0) AS cost FROM steps GROUP BY 1),
sel AS (SELECT r.*, expected, reference, len(list_intersect(expected, tools)) AS tp, len(expected) AS ne, len(tools) AS na,
  levenshtein(coalesce({_CODE.format('reference')}, ''), coalesce({_CODE.format('seq')}, '')) AS dist FROM runs r JOIN cases c ON c.run_id = r.run_id),
pr AS (SELECT *, CASE WHEN ne = 0 AND na = 0 THEN 1 WHEN na = 0 THEN 0 ELSE tp / na END::DOUBLE AS p,
  CASE WHEN ne = 0 AND na = 0 THEN 1 WHEN ne = 0 THEN 0 ELSE tp / ne END::DOUBLE AS r FROM sel),
sco AS (SELECT *, round_even(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS tool_selection,
  round_even(CASE WHEN greatest(len(reference), n_calls) = 0 THEN 1 ELSE 1 - dist / greatest(len(reference), n_calls)::DOUBLE END, 4) AS tool_order,
  round_even(CASE WHEN n_calls = 0 THEN CASE WHEN len(reference) = 0 THEN 1 ELSE 0 END WHEN len(reference) = 0 THEN 0
    ELSE least(1, len(reference) / n_calls::DOUBLE) END::DOUBLE, 4) AS efficiency,
  round_even((exp(-cost / {fixed.COST_BUDGET_USD}::DOUBLE) + exp(-wall / {fixed.LATENCY_BUDGET_S}::DOUBLE)) / 2, 4) AS cost_latency FROM pr)"""
_MEANS = ", ".join(f"round_even(avg({m}), 4) AS {m}" for m in tj.METRICS)
_AGENTS = _RUNS + f""",
ag0 AS (SELECT agent, {_MEANS}, count(*) AS runs, sum(round(cost::DECIMAL(20,10), 6))::DOUBLE AS total_cost_usd, sum(pt + ct)::BIGINT AS total_tokens,
  round(quantile_cont(round(wall, 3), 0.5), 3) AS latency_p50_s, round(quantile_cont(round(wall, 3), 0.95), 3) AS latency_p95_s FROM sco GROUP BY 1),
ag AS (SELECT *, ({' + '.join(tj.METRICS)}) / {len(tj.METRICS)} AS overall FROM ag0)"""

_PAIR_BASE = f"""
pairs AS ({PAIRS_SQL}),
outs AS (SELECT conv_id, turn, 'turn_' || turn AS category, 'base' AS system, prompt AS output, reply AS reference FROM pairs
  UNION ALL SELECT conv_id, turn, 'turn_' || turn, 'finetuned', {snippet_sql('reply', 3)}, reply FROM pairs),
toks AS (SELECT *, {tokens_sql('output', fixed.CONTRACTION_WORD)} AS ot, {tokens_sql('reference', fixed.CONTRACTION_WORD)} AS rt FROM outs),
kws AS (SELECT *, list_distinct(list_filter(rt, lambda t: length(t) >= 3 AND NOT list_contains({words_sql(fixed.COVERAGE_STOP_WORDS)}, t))) AS kw FROM toks),
gs AS (SELECT *, (ot = rt)::INT::DOUBLE AS exact_match,
  CASE WHEN len(kw) = 0 THEN 0 ELSE len(list_intersect(kw, list_distinct(ot))) / len(kw) END::DOUBLE AS keyword_coverage FROM kws)"""


def _keywords_sql(x: str) -> str:
    bare = f"list_transform({tokens_sql(x, fixed.DOTTED_WORD)}, lambda t: trim(t, '.'))"
    kept = (
        f"list_filter({bare}, lambda t: t <> '' AND NOT list_contains({words_sql(fixed.JUDGE_STOP_WORDS)}, t) "
        "AND (length(t) >= 3 OR regexp_full_match(t, '[0-9]+')))"
    )
    return kept


ORACLES = {
    "trajectories": f"""WITH {_RUNS} SELECT run_id, agent, n_steps, n_calls, array_to_string(tools, ',') AS tools, pt AS prompt_tokens,
  ct AS completion_tokens, round(wall, 3) AS wall_time_s, final_answer FROM runs""",
    "tool_sequences": f"""WITH steps AS ({STEPS_SQL}) SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY step_no) AS call_no, name
FROM steps WHERE type = 'tool_call'""",
    "tool_selection": f"""WITH {_RUNS} SELECT run_id, round_even(p, 4) AS precision, round_even(r, 4) AS recall, tool_selection AS f1,
  array_to_string(list_sort(list_filter(expected, lambda t: NOT list_contains(tools, t))), ',') AS missing,
  array_to_string(list_sort(list_filter(tools, lambda t: NOT list_contains(expected, t))), ',') AS unexpected FROM sco""",
    "tool_order": f"WITH {_RUNS} SELECT run_id, dist AS edit_distance, tool_order FROM sco",
    "efficiency": f"WITH {_RUNS} SELECT run_id, len(reference)::INT AS n_reference, n_calls, n_calls - n_distinct AS redundant_calls, efficiency FROM sco",
    "run_cost": f"WITH {_RUNS} SELECT run_id, round(cost, 8) AS cost_usd, pt + ct AS total_tokens FROM runs",
    "cost_latency": f"WITH {_RUNS} SELECT run_id, cost_latency FROM sco",
    "agent_summary": f"""WITH {_AGENTS} SELECT agent, {', '.join(tj.METRICS)}, round(overall, 6) AS overall, runs, total_cost_usd, total_tokens,
  latency_p50_s, latency_p95_s FROM ag""",
    "agent_comparison": f"WITH {_AGENTS} " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, " + ", ".join(f"round(max({m}) FILTER (agent = '{a}'), 6)::DOUBLE AS {a}" for a in AGENTS) + " FROM ag" for m in ROWS
    ),
    "gate_failures": f"WITH {_AGENTS} " + " UNION ALL ".join(
        f"SELECT agent, '{m}' AS metric, {m} AS score, {t}::DOUBLE AS required FROM ag WHERE {m} < {t}" for m, t in THRESHOLDS.items()
    ),
    "answer_scores": f"""WITH a AS (SELECT conv_id, turn, reply AS e, left(reply, ceil(length(reply) / 2)::INT) AS a FROM ({PAIRS_SQL})),
w0 AS (SELECT *, {_keywords_sql('e')} AS k0, {_keywords_sql('a')} AS have FROM a),
w AS (SELECT *, list_filter(k0, lambda t, i: list_position(k0, t) = i) AS k FROM w0),
h AS (SELECT *, list_filter(k, lambda t: list_contains(have, t) OR contains(lower(a), t)) AS f FROM w),
m AS (SELECT *, list_filter(k, lambda t: NOT list_contains(f, t)) AS miss FROM h),
j AS (SELECT *, CASE WHEN len(k) = 0 THEN CASE WHEN {strip_sql('a')} <> '' THEN 1 ELSE 0 END ELSE round_even(len(f) / len(k)::DOUBLE, 4) END::DOUBLE AS judge_score, lower({strip_sql('e')}) = lower({strip_sql('a')}) AND {strip_sql('e')} <> '' AS exact FROM m)
SELECT conv_id, turn, exact, judge_score, CASE WHEN exact THEN 1.0 ELSE round_even(judge_score, 4) END::DOUBLE AS score FROM j""",
    "judge_scores": f"""WITH a AS (SELECT conv_id, turn, reply AS e, left(reply, ceil(length(reply) / 2)::INT) AS a FROM ({PAIRS_SQL})),
w0 AS (SELECT *, {_keywords_sql('e')} AS k0, {_keywords_sql('a')} AS have FROM a),
w AS (SELECT *, list_filter(k0, lambda t, i: list_position(k0, t) = i) AS k FROM w0),
h AS (SELECT *, list_filter(k, lambda t: list_contains(have, t) OR contains(lower(a), t)) AS f FROM w),
m AS (SELECT *, list_filter(k, lambda t: NOT list_contains(f, t)) AS miss FROM h)
SELECT conv_id, turn, CASE WHEN len(k) = 0 THEN CASE WHEN {strip_sql('a')} <> '' THEN 1 ELSE 0 END ELSE round_even(len(f) / len(k)::DOUBLE, 4) END::DOUBLE AS score,
  CASE WHEN len(k) = 0 THEN 'No reference keywords; graded on non-empty answer.' ELSE
  'Covered ' || len(f) || '/' || len(k) || ' reference keywords.' || CASE WHEN len(miss) > 0 THEN ' Missing: ' || array_to_string(miss[1:6], ', ') || '.' ELSE '' END END AS rationale FROM m""",
    "exact_match": f"WITH {_PAIR_BASE} SELECT conv_id, turn, system, exact_match FROM gs",
    "keyword_coverage": f"WITH {_PAIR_BASE} SELECT conv_id, turn, system, round(keyword_coverage, 6) AS keyword_coverage FROM gs",
    "system_scores": f"""WITH {_PAIR_BASE} SELECT system, category, count(*) AS n_examples, round(avg(exact_match), 6) AS exact_match,
  round(avg(keyword_coverage), 6) AS keyword_coverage FROM gs GROUP BY 1, 2""",
    "system_deltas": f"""WITH {_PAIR_BASE} """ + " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, round(avg({m}) FILTER (system = 'base'), 6) AS base, round(avg({m}) FILTER (system = 'finetuned'), 6) AS tuned,
  round(avg({m}) FILTER (system = 'finetuned') - avg({m}) FILTER (system = 'base'), 6) AS delta FROM gs""" for m in _PLAIN
    ),
}
