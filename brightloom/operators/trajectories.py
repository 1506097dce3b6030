"""Evaluation of agent runs.

Steps are (run_id, agent, step_no, type, ts, name, arguments, content,
prompt_tokens, completion_tokens, model), ``step_no`` unique and increasing in
a run. Scores come from counts and sums that combine on the map side; only the
order score needs the sequence itself, and it cuts long runs into parts.

A metric is a function ``(runs) -> Column`` over the wide table of ``score_runs``
(``METRICS``); more can be passed to ``score_runs``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from brightloom.functions import fixed
from brightloom.functions.radix import quantiles
from brightloom.functions.ranking import row_numbers
from brightloom.functions.sequences import chain, edit_distance, edit_map

LONG_RUN = 20_000  # tool calls a single task may hold as one sequence
PART_SLICES = 256


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def tool_calls(steps: DataFrame) -> DataFrame:
    """(run_id, call_no, name): the ordered tool sequence as rows, so a run of any length stays distributed."""
    calls = steps.where(F.col("type") == "tool_call").select("run_id", "step_no", F.coalesce("name", F.lit("")).alias("name"))
    return row_numbers(calls, ["run_id"], "step_no", "call_no").select("run_id", "call_no", "name")


def step_cost(prices: Mapping[str, tuple[float, float]] = fixed.MODEL_PRICES) -> Column:
    """Dollars of one step; only model calls cost, an unknown model has the fallback price.

    The price table is a literal map in the expression: a lookup, not a join.
    """
    table = lambda i: F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, float(p[i]))])
    base = prices[fixed.FALLBACK_MODEL]
    price = lambda i: F.coalesce(F.try_element_at(table(i), F.col("model")), F.lit(float(base[i])))
    cost = F.col("prompt_tokens") / 1e6 * price(0) + F.col("completion_tokens") / 1e6 * price(1)
    return F.when(F.col("type") == "llm_call", cost).otherwise(F.lit(0.0))


def run_summary(steps: DataFrame) -> DataFrame:
    """One row per run: calls, distinct tools, tokens, cost, wall time and final answer."""
    is_call = F.col("type") == "tool_call"
    first, last = F.min_by(_micros(F.col("ts")), "step_no"), F.max_by(_micros(F.col("ts")), "step_no")
    out = steps.groupBy("run_id", "agent").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.count_if(is_call).alias("n_calls"),
        F.array_sort(F.collect_set(F.when(is_call, F.coalesce("name", F.lit(""))))).alias("tools"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(step_cost()).alias("cost_usd"),
        ((last - first) / 1e6).alias("wall_time_s"),
        F.max_by(F.col("content"), F.when(F.col("type") == "final_answer", F.col("step_no"))).alias("final_answer"),
    )
    return out.withColumn("final_answer", F.coalesce("final_answer", F.lit(""))).withColumn(
        "total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")
    )


def distinct_calls(steps: DataFrame) -> DataFrame:
    """(run_id, n_distinct): different (tool, sorted arguments) pairs per run, in two grouping steps."""
    args = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("arguments", F.expr("map()").cast("map<string,string>"))))))
    signed = steps.where(F.col("type") == "tool_call").select("run_id", "name", args.alias("args"))
    return signed.groupBy("run_id", "name", "args").agg(F.lit(1).alias("one")).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_distinct")
    )


# --- order score -----------------------------------------------------------------------


def _short_distances(calls: DataFrame, cases: DataFrame) -> DataFrame:
    """Built-in ``levenshtein`` on one private-use character per tool of the run and its reference."""
    seqs = calls.groupBy("run_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step_no", "name"))), lambda s: s["name"]).alias("actual")
    )
    both = cases.select("run_id", "reference").join(seqs, "run_id", "left").withColumn(
        "actual", F.coalesce("actual", F.array().cast("array<string>"))
    )
    names = F.array_union("reference", "actual")
    # Position of a tool in the pair's own vocabulary, as a character from the basic plane.
    coded = lambda seq: F.array_join(F.transform(seq, lambda t: F.chr(F.lit(33) + F.array_position(F.col("_names"), t))), "")
    small = both.withColumn("_names", names)
    return small.select(
        "run_id",
        F.when(F.size("_names") <= 90, F.levenshtein(coded(F.col("reference")), coded(F.col("actual")))).alias("distance"),
        "reference", "actual",
    )


def _wide_vocabulary(df: DataFrame) -> DataFrame:
    """Distances of the (rare) pairs with more tools than single characters: same kernel, no coding."""

    def run(batches):
        for b in batches:
            d = [edit_distance(list(r), list(a)) for r, a in zip(b["reference"], b["actual"])]
            yield pd.DataFrame({"run_id": b["run_id"], "distance": np.array(d, dtype="int64")})

    return df.where(F.col("distance").isNull()).select("run_id", "reference", "actual").mapInPandas(run, "run_id string, distance long")


def _long_distances(calls: DataFrame, cases: DataFrame) -> DataFrame:
    """Runs too long for one task: an edit-cost map per ordered part, combined per run.

    Part edges are sketch quantiles of ``step_no``; any increasing edges are exact.
    """
    cuts = [i / PART_SLICES for i in range(1, PART_SLICES)]
    edges = calls.groupBy("run_id").agg(F.percentile_approx("step_no", cuts, F.lit(PART_SLICES * 20)).alias("_e"))
    parts = calls.join(edges, "run_id").withColumn("part", F.size(F.filter("_e", lambda e: e < F.col("step_no")))).drop("_e")
    # Few runs are that long, and a reference is a short list: it rides along with the steps.
    parts = parts.join(cases.select("run_id", "reference"), "run_id")

    def one_part(key: tuple, steps: pd.DataFrame) -> pd.DataFrame:
        names = steps.sort_values("step_no")["name"].tolist()
        costs = edit_map(list(steps["reference"].iloc[0]), names)
        return pd.DataFrame({"run_id": [key[0]], "part": [key[1]], "cost": [costs.ravel().tolist()]})

    maps = parts.groupBy("run_id", "part").applyInPandas(one_part, "run_id string, part int, cost array<double>")

    def combine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        side = int(round(len(pdf["cost"].iloc[0]) ** 0.5))
        ordered = [np.asarray(c, dtype=float).reshape(side, side) for c in pdf.sort_values("part")["cost"]]
        return pd.DataFrame({"run_id": [key[0]], "distance": [int(chain(ordered))]})

    return maps.groupBy("run_id").applyInPandas(combine, "run_id string, distance long")


def order_distance(steps: DataFrame, cases: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """(run_id, distance, n_reference): edit distance between the tool sequence and the reference."""
    calls = steps.where(F.col("type") == "tool_call").select("run_id", "step_no", F.coalesce("name", F.lit("")).alias("name"))
    cases = with_reference(cases)
    long_ids = calls.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long_run).select("run_id")
    short = _short_distances(calls.join(long_ids, "run_id", "left_anti"), cases.join(long_ids, "run_id", "left_anti"))
    coded = short.where(F.col("distance").isNotNull()).select("run_id", F.col("distance").cast("long").alias("distance"))
    large = _long_distances(calls.join(long_ids, "run_id", "left_semi"), cases.join(long_ids, "run_id", "left_semi"))
    found = coded.unionByName(_wide_vocabulary(short)).unionByName(large)
    return cases.select("run_id", F.size("reference").alias("n_reference")).join(found, "run_id")


# --- scores -------------------------------------------------------------------------------


def with_reference(cases: DataFrame) -> DataFrame:
    """Adds ``reference``: the reference sequence, else the expected tools in their order."""
    return cases.withColumn("reference", F.coalesce("reference_trajectory", "expected_tools"))


def four(x: Column) -> Column:
    return F.bround(x, 4)


def selection_parts(expected: Column, actual: Column) -> dict[str, Column]:
    """Precision, recall and F1 of distinct tools; both empty counts as perfect."""
    e, a = F.array_distinct(expected), F.array_distinct(actual)
    hits = F.size(F.array_intersect(e, a))
    none = (F.size(e) == 0) & (F.size(a) == 0)
    p = F.coalesce(F.try_divide(hits, F.size(a)), F.lit(0.0))
    r = F.coalesce(F.try_divide(hits, F.size(e)), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    one = F.lit(1.0)
    return {
        "precision": four(F.when(none, one).otherwise(p)),
        "recall": four(F.when(none, one).otherwise(r)),
        "f1": four(F.when(none, one).otherwise(f1)),
        "missing": F.array_sort(F.array_except(e, a)),
        "unexpected": F.array_sort(F.array_except(a, e)),
    }


def _tool_selection() -> Column:
    return selection_parts(F.col("expected_tools"), F.col("tools"))["f1"]


def _tool_order() -> Column:
    longest = F.greatest(F.col("n_reference").cast("long"), F.col("n_calls"))
    return four(F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.try_divide("distance", longest)))


def _efficiency() -> Column:
    ref, n = F.col("n_reference"), F.col("n_calls")
    return four(
        F.when(n == 0, F.when(ref == 0, 1.0).otherwise(0.0)).when(ref == 0, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(ref, n)))
    )


def _cost_latency() -> Column:
    return four((F.exp(-F.col("cost_usd") / fixed.COST_BUDGET_USD) + F.exp(-F.col("wall_time_s") / fixed.LATENCY_BUDGET_S)) / 2)


METRICS: dict[str, Callable[[], Column]] = {
    "tool_selection": _tool_selection,
    "tool_order": _tool_order,
    "efficiency": _efficiency,
    "cost_latency": _cost_latency,
}


def score_runs(steps: DataFrame, cases: DataFrame, metrics: Mapping[str, Callable[[], Column]] = METRICS) -> DataFrame:
    """Wide table: run summary, its case, and one score column per metric."""
    wide = (
        run_summary(steps)
        .join(with_reference(cases), "run_id")
        .join(order_distance(steps, cases), "run_id")
        .join(distinct_calls(steps), "run_id", "left")
        .withColumn("redundant_calls", F.col("n_calls") - F.coalesce("n_distinct", F.lit(0)))
    )
    return wide.withColumns({name: build() for name, build in metrics.items()})


def agent_summary(scored: DataFrame, metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """Per agent: mean scores, overall, totals, exact p50 / p95 of wall time (0 when empty)."""
    shaped = scored.withColumn("_wall", F.round("wall_time_s", 3)).withColumn(
        "_cost", F.round(F.col("cost_usd").cast("decimal(20,10)"), 6)  # cents of a cent, so sums are exact
    )
    means = shaped.groupBy("agent").agg(
        *[four(F.avg(m)).alias(m) for m in metrics],
        F.count(F.lit(1)).alias("runs"),
        F.sum("_cost").cast("double").alias("total_cost_usd"),
        F.sum("total_tokens").alias("total_tokens"),
    )
    cuts = quantiles(shaped, ["agent"], "_wall", [0.5, 0.95])
    total = sum((F.col(m) for m in metrics[1:]), F.col(metrics[0]))
    return means.join(cuts, "agent", "left").select(
        "agent", *metrics, (total / len(metrics)).alias("overall"), "runs", "total_cost_usd", "total_tokens",
        F.coalesce(F.round(F.col("quantiles")[0], 3), F.lit(0.0)).alias("latency_p50_s"),
        F.coalesce(F.round(F.col("quantiles")[1], 3), F.lit(0.0)).alias("latency_p95_s"),
    )


def comparison(summary: DataFrame, agents: Sequence[str], rows: Sequence[str]) -> DataFrame:
    """Metric x agent table."""
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in rows]
    long = summary.select("agent", F.explode(F.array(*cells)).alias("c")).select("agent", "c.metric", "c.value")
    return long.groupBy("metric").pivot("agent", list(agents)).agg(F.first("value"))


class ThresholdsMissed(AssertionError):
    """Raised by ``assert_agents_pass``."""


def gate_failures(summary: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """(agent, metric, score, required) below their minimum; an unknown metric is an error."""
    unknown = sorted(set(thresholds) - set(summary.columns))
    if unknown:
        raise KeyError(f"no such metrics: {unknown}; the summary has {sorted(summary.columns)}")
    cells = [
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("score"), F.lit(float(t)).alias("required"))
        for m, t in thresholds.items()
    ]
    return summary.select("agent", F.explode(F.array(*cells)).alias("c")).select("agent", "c.*").where(
        F.col("score") < F.col("required")
    )


def assert_agents_pass(summary: DataFrame, thresholds: Mapping[str, float]) -> None:
    failed = gate_failures(summary, thresholds).orderBy("agent", "metric").collect()
    if failed:
        lines = [f"{r['agent']} {r['metric']}: {r['score']:.3f} < required {r['required']:.3f}" for r in failed]
        raise ThresholdsMissed(f"{len(failed)} scores below their minimum:\n  " + "\n  ".join(lines))
