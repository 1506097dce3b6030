"""Registered contract, drift, promotion and telemetry queries with their oracles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from brightloom.functions import fixed
from brightloom.operators import classification as cl, drift as dr, promotion as pm, quality as ql, telemetry as tm
from brightloom.plans.bindings import (
    LINE_CATEGORICAL, LINE_NUMERIC, SCORED_SQL, SPLIT_DAY, audit_log, line_windows, scored_customers,
)
from brightloom.plans.scoring_queries import LINE_RULES, _metrics_sql
from brightloom.session import materialised, scratch_path
from brightloom.streaming import drift as sd, runs, telemetry as st
from brightloom.sources.tables import table

RULES = (*LINE_RULES, ql.ColumnRule("l_comment", "categorical"))
CONTRACT = "line_items_v1"
#: Events before this day are the reference of the drift stream.
EVENT_SPLIT = "2024-01-11"
LATENCY_EDGES = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


def _line(spark, sf):
    return table(spark, sf, "lineitem")


def schema_checks(spark, sf):
    return ql.validation_report(_line(spark, sf), CONTRACT, RULES).where(F.col("check_name").isin("presence", "dtype"))


def null_fractions(spark, sf):
    out = ql.value_checks(_line(spark, sf), RULES).where(F.col("check_name") == "null_fraction")
    return out.select("column_name", F.round("measured", 6).alias("null_fraction"), "passed")


def range_checks(spark, sf):
    out = ql.value_checks(_line(spark, sf), RULES).where(F.col("check_name") == "range")
    return out.select("column_name", F.col("measured").cast("long").alias("outside"), "passed", "detail")


def domain_checks(spark, sf):
    return ql.domain_checks(_line(spark, sf), RULES)


def domain_violations(spark, sf):
    return ql.domain_violations(_line(spark, sf), RULES)


def validation_report(spark, sf):
    return ql.validation_report(_line(spark, sf), CONTRACT, RULES)


def _numbers(spark, sf):
    ref, cur = line_windows(spark, sf)
    return dr.feature_values(ref, LINE_NUMERIC), dr.feature_values(cur, LINE_NUMERIC, "window")


def psi_numeric(spark, sf):
    out = dr.psi_numeric(*_numbers(spark, sf))
    return out.select("feature", F.round("psi", 6).alias("psi"))


def psi_categorical(spark, sf):
    ref, cur = line_windows(spark, sf)
    out = dr.psi_categorical(
        dr.feature_counts(ref, LINE_CATEGORICAL, "string"), dr.feature_counts(cur, LINE_CATEGORICAL, "string", "window")
    )
    return out.select("feature", F.round("psi", 6).alias("psi"))


def ks_statistic(spark, sf):
    out = dr.ks_statistic(*_numbers(spark, sf))
    return out.select("feature", F.round("ks_statistic", 6).alias("ks_statistic"), "n_reference", "n_current")


def drift_report(spark, sf):
    ref, cur = line_windows(spark, sf)
    return dr.drift_report(ref, cur, "window", LINE_NUMERIC, LINE_CATEGORICAL)


def drift_by_month(spark, sf):
    ref, cur = line_windows(spark, sf, monthly=True)
    return dr.drift_report(ref, cur, "window", LINE_NUMERIC, LINE_CATEGORICAL)


def promotion_decisions(spark, sf):
    m = cl.classification_metrics(scored_customers(spark, sf)).withColumn("line", F.when(F.col("model") == "by_balance", "b").otherwise("a"))
    candidates = m.select("line", F.col("model").alias("candidate"), F.col("roc_auc").alias("auc"), "brier")
    incumbents = m.where(F.col("model") == "by_tenure").select("line", F.col("roc_auc").alias("auc"))
    out = pm.promotion_decisions(candidates, incumbents, "line")
    return out.select("line", "candidate", "promote", F.array_join("reasons", "; ").alias("reasons"))


def registry_state(spark, sf):
    return pm.registry_state(audit_log(spark, sf))


def rollback_events(spark, sf):
    """What a rollback of every model that has an earlier version would write to the log."""
    audit = audit_log(spark, sf)
    able = pm.registry_state(audit).where("rollback_target is not null").select("model")
    out = pm.rollback_events(audit.join(able, "model", "left_semi"), "manual")
    return out.select("model", "event", "version", "previous_version", "reason")


def telemetry_histogram(spark, sf):
    return tm.histogram(table(spark, sf, "events"), ["event_type"], "value", LATENCY_EDGES)


def windowed_telemetry(spark, sf):
    """The streaming histogram per hour, over the stored events."""
    return st.windowed_histogram(table(spark, sf, "events"), "ts", "event_type", "value", LATENCY_EDGES)


def windowed_requests(spark, sf):
    return st.request_rate(table(spark, sf, "events"), "ts", "event_type")


def _stream_events(spark, sf):
    return table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def streamed_telemetry(spark, sf):
    """The events as a stream: watermark, state per open window, every window appended once it is closed."""
    stream = runs.closed_stream(_stream_events(spark, sf), "ts")
    return runs.appended(st.windowed_histogram(stream, "ts", "event_type", "value", LATENCY_EDGES)).where("event_type is not null")


def streamed_drift(spark, sf):
    """Verdicts per day of the events after the split, against a profile of those before it."""
    events, cut = _stream_events(spark, sf), F.lit(EVENT_SPLIT).cast("timestamp")
    profile = materialised(sd.frozen_profile(events.where(F.col("ts") < cut), ["value"]), "profile")
    stream = runs.closed_stream(events.where(F.col("ts") >= cut), "ts")
    path = scratch_path(spark, "verdicts")
    runs.each_batch(sd.windowed_bins(stream, "ts", ["value"], profile, "1 day"), sd.write_verdicts(profile, path))
    return spark.read.parquet(path).select("window_start", "feature", F.round("psi", 6).alias("psi"), "severity")


def request_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("status", F.when(F.col("event_type") == "error", 500).otherwise(200))
    return tm.request_counts(e.select(F.col("event_type").alias("endpoint"), "status"), "endpoint", "status")


def score_histogram(spark, sf):
    s = scored_customers(spark, sf).withColumn("predicted_class", (F.col("score") >= 0.5).cast("int"))
    return tm.histogram(s, ["model", "predicted_class"], "score", tm.SCORE_EDGES)


QUERIES = {
    f.__name__: f
    for f in (
        schema_checks, null_fractions, range_checks, domain_checks, domain_violations, validation_report, psi_numeric,
        psi_categorical, ks_statistic, drift_report, drift_by_month, promotion_decisions, registry_state, rollback_events,
        telemetry_histogram, windowed_telemetry, windowed_requests, streamed_telemetry, streamed_drift, request_counts, score_histogram,
    )
}

# --- oracles ---------------------------------------------------------------------------

_HASH = f"left(sha256('{ql.contract_json(CONTRACT, RULES)}'), 16)"
_HERE = LINE_RULES
_RANGED = [r for r in _HERE if r.min_value is not None or r.max_value is not None]
_LIMITED = [r for r in _HERE if r.allowed_values]


def _outside_sql(r):
    tests = []
    if r.min_value is not None:
        tests.append(f"{r.name} < {r.min_value}")
    if r.max_value is not None:
        tests.append(f"{r.name} > {r.max_value}::DOUBLE")
    return " OR ".join(tests)


def _bounds_sql(r):
    low = "-inf" if r.min_value is None else str(float(r.min_value))
    high = "inf" if r.max_value is None else str(float(r.max_value))
    return f"[{low}, {high}]"


_NULLS = " UNION ALL ".join(f"SELECT '{r.name}' AS column_name, avg(({r.name} IS NULL)::INT) AS part FROM lineitem" for r in _HERE)
_RANGES = " UNION ALL ".join(
    f"SELECT '{r.name}' AS column_name, count(*) FILTER ({_outside_sql(r)}) AS outside, '{_bounds_sql(r)}' AS bounds FROM lineitem" for r in _RANGED
)
_RANGE_OUT = "SELECT column_name, outside, outside = 0 AS passed, CASE WHEN outside = 0 THEN '' ELSE outside || ' values outside ' || bounds END AS detail FROM rg"
_DOMAINS = " UNION ALL ".join(
    f"SELECT '{r.name}' AS column_name, count(DISTINCT {r.name}) FILTER ({r.name} NOT IN {r.allowed_values}) AS unexpected_values, "
    f"count(*) FILTER ({r.name} NOT IN {r.allowed_values}) AS unexpected_rows FROM lineitem" for r in _LIMITED
)
_SCHEMA = " UNION ALL ".join(
    [f"SELECT '{r.name}' AS column_name, 'dtype' AS check_name, true AS passed, '' AS detail" for r in _HERE]
    + ["SELECT 'l_comment', 'presence', false, 'column missing'"]
)
_LONG_NUM = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value, win, cur FROM li" for c in LINE_NUMERIC)
_LONG_CAT = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, win, cur FROM li" for c in LINE_CATEGORICAL)


def _drift_ctes(window: str) -> str:
    c = math.sqrt(-0.5 * math.log(fixed.KS_ALPHA / 2.0))
    inner = ", ".join(repr(i * 0.1) for i in range(1, 10))
    return f"""
li AS (SELECT *, l_shipdate >= DATE '{SPLIT_DAY}' AS cur, {window} AS win FROM lineitem),
num AS ({_LONG_NUM}), cat AS ({_LONG_CAT}),
wins AS (SELECT DISTINCT win FROM li WHERE cur),
edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [{inner}]))) AS e FROM num WHERE NOT cur GROUP BY 1),
binned AS (SELECT n.feature, cur, win, len(list_filter(e, lambda x: x <= value)) AS bin FROM num n JOIN edges g ON g.feature = n.feature),
bins AS (SELECT feature, unnest(range(0, len(e) + 1)) AS bin FROM edges),
rb AS (SELECT feature, bin, count(*) AS n FROM binned WHERE NOT cur GROUP BY 1, 2),
cb AS (SELECT feature, win, bin, count(*) AS n FROM binned WHERE cur GROUP BY 1, 2, 3),
rt AS (SELECT feature, sum(n) AS t FROM rb GROUP BY 1), ct AS (SELECT feature, win, sum(n) AS t FROM cb GROUP BY 1, 2),
fn AS (SELECT b.feature, w.win, greatest(coalesce(rb.n, 0) / rt.t, 1e-4) AS r, greatest(coalesce(cb.n, 0) / ct.t, 1e-4) AS c
  FROM bins b CROSS JOIN wins w JOIN rt ON rt.feature = b.feature JOIN ct ON ct.feature = b.feature AND ct.win = w.win
  LEFT JOIN rb ON rb.feature = b.feature AND rb.bin = b.bin LEFT JOIN cb ON cb.feature = b.feature AND cb.win = w.win AND cb.bin = b.bin),
psin AS (SELECT feature, win, sum((c - r) * ln(c / r)) AS psi FROM fn GROUP BY 1, 2),
cats AS (SELECT DISTINCT feature, value FROM cat WHERE value IS NOT NULL),
cr AS (SELECT feature, value, count(*) AS n FROM cat WHERE NOT cur GROUP BY 1, 2),
cc AS (SELECT feature, win, value, count(*) AS n FROM cat WHERE cur GROUP BY 1, 2, 3),
crt AS (SELECT feature, sum(n) AS t FROM cr GROUP BY 1), cct AS (SELECT feature, win, sum(n) AS t FROM cc GROUP BY 1, 2),
fc AS (SELECT k.feature, w.win, greatest(coalesce(cr.n, 0) / crt.t, 1e-4) AS r, greatest(coalesce(cc.n, 0) / cct.t, 1e-4) AS c
  FROM cats k CROSS JOIN wins w JOIN crt ON crt.feature = k.feature JOIN cct ON cct.feature = k.feature AND cct.win = w.win
  LEFT JOIN cr ON cr.feature = k.feature AND cr.value = k.value LEFT JOIN cc ON cc.feature = k.feature AND cc.win = w.win AND cc.value = k.value),
psic AS (SELECT feature, win, sum((c - r) * ln(c / r)) AS psi FROM fc GROUP BY 1, 2),
pool AS (SELECT feature, w.win, value, count(*) FILTER (NOT cur) AS rn, count(*) FILTER (cur AND n.win = w.win) AS cn
  FROM num n CROSS JOIN wins w WHERE NOT cur OR n.win = w.win GROUP BY 1, 2, 3),
ec AS (SELECT *, sum(rn) OVER o AS rc, sum(cn) OVER o AS cu, sum(rn) OVER p AS ra, sum(cn) OVER p AS ca FROM pool
  WINDOW o AS (PARTITION BY feature, win ORDER BY value), p AS (PARTITION BY feature, win)),
ks AS (SELECT feature, win, max(abs(rc / ra - cu / ca)) AS ks, max(ra)::BIGINT AS nr, max(ca)::BIGINT AS nc,
  {c!r} * sqrt((max(ra) + max(ca))::DOUBLE / (max(ra)::DOUBLE * max(ca))) AS kc FROM ec GROUP BY 1, 2),
rep AS (
  SELECT p.win AS "window", p.feature, p.psi, ks, kc, CASE WHEN p.psi >= 0.25 THEN 'alert' WHEN p.psi >= 0.1 OR ks > kc THEN 'warn' ELSE 'none' END AS severity
  FROM psin p JOIN ks ON ks.feature = p.feature AND ks.win = p.win
  UNION ALL SELECT win, feature, psi, NULL, NULL, CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.1 THEN 'warn' ELSE 'none' END FROM psic),
full_rep AS (SELECT "window", feature, round(psi, 6) AS psi, round(ks, 6) AS ks_statistic, round(kc, 6) AS ks_critical, severity,
  count(*) FILTER (severity = 'alert') OVER (PARTITION BY "window") AS alerts,
  count(*) FILTER (severity = 'alert') OVER (PARTITION BY "window") >= 2 AS retrain FROM rep)"""


_ALL, _MONTH = _drift_ctes("'all'"), _drift_ctes("strftime(l_shipdate, '%Y-%m')")
_D = lambda x: f"round(({x})::VARCHAR::DECIMAL(38,24), 4)::DOUBLE"  # noqa: E731  (half up on the decimal digits, rounded once)
_REQ = f"prod + {fixed.PROMOTION_MARGIN}"

ORACLES = {
    "schema_checks": f"SELECT *, {_HASH} AS schema_hash FROM ({_SCHEMA})",
    "null_fractions": f"SELECT column_name, round(part, 6) AS null_fraction, part <= 0 AS passed FROM ({_NULLS})",
    "range_checks": f"WITH rg AS ({_RANGES}) {_RANGE_OUT}",
    "domain_checks": f"SELECT *, unexpected_values = 0 AS passed FROM ({_DOMAINS})",
    "domain_violations": " UNION ALL ".join(
        f"SELECT '{r.name}' AS column_name, {r.name} AS value, count(*) AS n FROM lineitem WHERE {r.name} NOT IN {r.allowed_values} GROUP BY 2"
        for r in _LIMITED
    ),
    "validation_report": f"""WITH rg AS ({_RANGES}), dm AS ({_DOMAINS}), nf AS ({_NULLS}), u AS (
SELECT * FROM ({_SCHEMA})
UNION ALL SELECT column_name, 'null_fraction', part <= 0, CASE WHEN part <= 0 THEN '' ELSE printf('%.3f > allowed 0.000', part) END FROM nf
UNION ALL SELECT column_name, 'range', passed, detail FROM ({_RANGE_OUT})
UNION ALL SELECT column_name, 'category_domain', unexpected_values = 0,
  CASE WHEN unexpected_values = 0 THEN '' ELSE unexpected_values || ' unexpected values in ' || unexpected_rows || ' rows' END FROM dm)
SELECT *, {_HASH} AS schema_hash FROM u""",
    "psi_numeric": f"WITH {_ALL} SELECT feature, round(psi, 6) AS psi FROM psin",
    "psi_categorical": f"WITH {_ALL} SELECT feature, round(psi, 6) AS psi FROM psic",
    "ks_statistic": f"WITH {_ALL} SELECT feature, round(ks, 6) AS ks_statistic, nr AS n_reference, nc AS n_current FROM ks",
    "drift_report": f"WITH {_ALL} SELECT * FROM full_rep",
    "drift_by_month": f"WITH {_MONTH} SELECT * FROM full_rep",
    "promotion_decisions": f"""WITH {_metrics_sql(SCORED_SQL, 'model')},
c AS (SELECT CASE WHEN model = 'by_balance' THEN 'b' ELSE 'a' END AS line, model AS candidate, roc_auc AS auc, brier FROM met),
j AS (SELECT c.*, i.auc AS prod FROM c LEFT JOIN c i ON i.line = c.line AND i.candidate = 'by_tenure')
SELECT line, candidate, auc >= 0.7 AND brier <= 0.2 AND (prod IS NULL OR auc >= {_REQ}) AS promote,
  array_to_string(list_filter([
    CASE WHEN auc < 0.7 THEN printf('candidate auc %.4f below floor 0.70', {_D('auc')}) END,
    CASE WHEN brier > 0.2 THEN printf('candidate brier %.4f above cap 0.20', {_D('brier')}) END,
    CASE WHEN prod IS NULL AND auc >= 0.7 AND brier <= 0.2 THEN 'no production model - first promotion' END,
    CASE WHEN auc >= {_REQ} THEN printf('candidate auc %.4f beats production %.4f + margin 0.005', {_D('auc')}, {_D('prod')}) END,
    CASE WHEN auc < {_REQ} THEN printf('candidate auc %.4f < required %.4f (production %.4f + margin 0.005)', {_D('auc')}, {_D(_REQ)}, {_D('prod')}) END
  ], lambda x: x IS NOT NULL), '; ') AS reasons FROM j""",
    "registry_state": """WITH a AS (SELECT user_id AS model, event_id AS seq, (props->>'k')::BIGINT AS version FROM events
  WHERE event_type IN ('purchase', 'error')),
cur AS (SELECT model, arg_max(version, seq) AS v FROM a GROUP BY 1)
SELECT cur.model, any_value(v) AS current_version, arg_max(version, seq) FILTER (version <> v) AS rollback_target
FROM cur JOIN a ON a.model = cur.model GROUP BY 1""",
    "telemetry_histogram": " UNION ALL ".join(
        f"SELECT event_type, '{e}' AS le, count(*) FILTER (value <= {e}) AS observations FROM events GROUP BY 1" for e in LATENCY_EDGES
    ) + " UNION ALL SELECT event_type, '+Inf', count(value) FROM events GROUP BY 1",
    "windowed_telemetry": "SELECT date_trunc('hour', ts) AS window_start, event_type, CASE "
    + " ".join(f"WHEN value <= {e} THEN '{float(e)}'" for e in LATENCY_EDGES)
    + " ELSE '+Inf' END AS le, count(*) AS observations FROM events GROUP BY 1, 2, 3",
    "streamed_drift": f"""WITH ref AS (SELECT value FROM events WHERE ts < TIMESTAMP '{EVENT_SPLIT}' AND value IS NOT NULL),
e AS (SELECT list_sort(list_distinct(quantile_cont(value, [{", ".join(repr(i * 0.1) for i in range(1, 10))}]))) AS e FROM ref),
bins AS (SELECT unnest(range(0, len(e) + 1)) AS bin FROM e),
rb AS (SELECT len(list_filter(e, lambda x: x <= value)) AS bin, count(*) AS n FROM ref, e GROUP BY 1),
cb AS (SELECT date_trunc('day', ts)::TIMESTAMP AS w, len(list_filter(e, lambda x: x <= value)) AS bin, count(*) AS n FROM events, e
  WHERE ts >= TIMESTAMP '{EVENT_SPLIT}' AND value IS NOT NULL GROUP BY 1, 2),
ct AS (SELECT w, sum(n) AS t FROM cb GROUP BY 1),
f AS (SELECT ct.w, greatest(coalesce(rb.n, 0) / (SELECT count(*) FROM ref), 1e-4) AS r, greatest(coalesce(cb.n, 0) / ct.t, 1e-4) AS c
  FROM bins b CROSS JOIN ct LEFT JOIN rb ON rb.bin = b.bin LEFT JOIN cb ON cb.bin = b.bin AND cb.w = ct.w),
p AS (SELECT w, sum((c - r) * ln(c / r)) AS psi FROM f GROUP BY 1)
SELECT w AS window_start, 'value' AS feature, round(psi, 6) AS psi, CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.1 THEN 'warn' ELSE 'none' END AS severity FROM p""",
    "windowed_requests": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS requests FROM events GROUP BY 1, 2",
    "request_counts": "SELECT event_type AS endpoint, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, count(*) AS requests FROM events GROUP BY 1, 2",
    "score_histogram": f"WITH s AS (SELECT *, (score >= 0.5)::INT AS predicted_class FROM ({SCORED_SQL})) "
    + " UNION ALL ".join(
        f"SELECT model, predicted_class, '{e}' AS le, count(*) FILTER (score <= {e}::DOUBLE) AS observations FROM s GROUP BY 1, 2" for e in tm.SCORE_EDGES
    ) + " UNION ALL SELECT model, predicted_class, '+Inf', count(score) FROM s GROUP BY 1, 2",
}
ORACLES["streamed_telemetry"] = ORACLES["windowed_telemetry"]
ORACLES["rollback_events"] = f"""SELECT model, 'rollback' AS event, rollback_target AS version, current_version AS previous_version, 'manual' AS reason
FROM ({ORACLES["registry_state"]}) WHERE rollback_target IS NOT NULL"""
