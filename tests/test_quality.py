import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.operators import drift as dr, promotion as pm, quality as ql, telemetry as tm
from brightloom.plans.quality_queries import _D

RULES = (
    ql.ColumnRule("age", "integer", 18, 100), ql.ColumnRule("income", "numeric", 0, max_null_fraction=0.25),
    ql.ColumnRule("status", "categorical", allowed_values=("on", "off")),
)


def people(spark, rows):
    return spark.createDataFrame(rows, "age int, income double, status string")


def report(df, rules=RULES):
    return {(r["column_name"], r["check_name"]): (r["passed"], r["detail"]) for r in ql.validation_report(df, "c", rules).collect()}


def test_valid_frame(spark):
    df = people(spark, [(20, 1.0, "on"), (30, None, "off"), (40, 2.0, "on"), (50, 3.0, None)])
    rules = (*RULES[:2], ql.ColumnRule("status", "categorical", max_null_fraction=0.5, allowed_values=("on", "off")))
    got = report(df, rules)
    assert all(passed for passed, _ in got.values()) and len(got) == 9
    ql.require_valid(ql.validation_report(df, "c", rules))


def test_failures_are_listed(spark):
    df = people(spark, [(17, -1.0, "on"), (30, None, "maybe"), (101, None, "maybe")])
    rules = (*RULES, ql.ColumnRule("city", "categorical"))
    got = report(df, rules)
    assert got[("city", "presence")] == (False, "column missing") and ("city", "null_fraction") not in got
    assert got[("age", "range")] == (False, "2 values outside [18.0, 100.0]")
    assert got[("income", "null_fraction")] == (False, "0.667 > allowed 0.250")
    assert got[("status", "category_domain")] == (False, "1 unexpected values in 2 rows")
    with pytest.raises(ql.ContractBroken, match="age/range"):
        ql.require_valid(ql.validation_report(df, "c", rules))


def test_kinds(spark):
    df = people(spark, [(20, 1.0, "on")])
    wrong = (ql.ColumnRule("income", "integer"), ql.ColumnRule("status", "numeric"), ql.ColumnRule("age", "categorical"), ql.ColumnRule("income", "categorical"))
    assert [r["passed"] for r in ql.schema_checks(df, wrong).collect()] == [False, False, True, False]


def test_hash_is_stable_and_sensitive():
    assert ql.contract_hash("c", RULES) == ql.contract_hash("c", RULES) != ql.contract_hash("d", RULES)
    assert len(ql.contract_hash("c", RULES)) == 16


def test_quarantine(spark):
    rows = [(20, 1.0, "on"), (17, 1.0, "x"), (None, 1.0, "on"), (20, None, "on")]
    good, bad = ql.quarantine(people(spark, rows), RULES)
    assert good.count() == 2 and sorted(tuple(r["reasons"]) for r in bad.collect()) == [
        ("age missing",), ("age outside [18.0, 100.0]", "status unexpected")
    ]
    with pytest.raises(ql.ContractBroken, match="unexpected columns"):
        ql.quarantine(people(spark, rows).withColumn("extra", F.lit(1)), RULES)


def counts(spark, values, window=None):
    kind = "string" if isinstance(values[0], str) else "double"
    df = spark.createDataFrame([(v, window) for v in values], f"f {kind}, w string")
    return dr.feature_counts(df, ["f"], kind, "w" if window else None)


def numpy_psi(ref, cur, bins=10):
    edges = np.quantile(ref, np.linspace(0, 1, bins + 1))
    edges[0], edges[-1] = -np.inf, np.inf
    edges = np.unique(edges)
    r = np.maximum(np.histogram(ref, edges)[0] / len(ref), 1e-4)
    c = np.maximum(np.histogram(cur, edges)[0] / len(cur), 1e-4)
    return float(np.sum((c - r) * np.log(c / r)))


@pytest.mark.parametrize("shift", [0.0, 1.0, 30.0])
def test_psi_numeric(spark, shift):
    rng = np.random.default_rng(0)
    ref, cur = np.round(rng.normal(0, 1, 800), 1), np.round(rng.normal(shift, 1, 300), 1)
    got = dr.psi_numeric(counts(spark, ref.tolist()), counts(spark, cur.tolist(), "w")).first()["psi"]
    assert got == pytest.approx(numpy_psi(ref, cur))
    rows = spark.createDataFrame([(float(v), "w") for v in cur], "f double, w string")
    plain = spark.createDataFrame([(float(v),) for v in ref], "f double")
    again = dr.psi_numeric(dr.feature_values(plain, ["f"]), dr.feature_values(rows, ["f"], "w")).first()
    assert again["psi"] == pytest.approx(got) and again["window"] == "w"
    edges = dr.bin_edges(dr.feature_values(plain, ["f"])).first()["edges"]
    assert edges == pytest.approx(list(dict.fromkeys(np.quantile(ref, np.linspace(0, 1, 11))[1:-1].tolist())))


def test_psi_same_sample_and_shift(spark):
    v = [float(i) for i in range(200)]
    assert dr.psi_numeric(counts(spark, v), counts(spark, v, "w")).first()["psi"] == pytest.approx(0)
    assert dr.psi_numeric(counts(spark, v), counts(spark, [x + 60 for x in v], "w")).first()["psi"] > 0.25


def test_psi_categorical(spark):
    got = dr.psi_categorical(counts(spark, ["a"] * 50 + ["b"] * 50), counts(spark, ["a"] * 80 + ["b"] * 20, "w")).first()["psi"]
    assert got == pytest.approx(0.3 * math.log(1.6) - 0.3 * math.log(0.4))


def test_ks(spark):
    got = dr.ks_statistic(counts(spark, [1.0, 2.0, 3.0, 4.0]), counts(spark, [3.0, 4.0, 5.0, 6.0], "w")).first()
    assert got["ks_statistic"] == 0.5 and (got["n_reference"], got["n_current"]) == (4, 4)
    rng = np.random.default_rng(1)
    ref, cur = np.round(rng.normal(0, 1, 300), 1), np.round(rng.normal(0.3, 2, 200), 1)
    pool = np.concatenate([ref, cur])
    f = lambda s: np.searchsorted(np.sort(s), pool, side="right") / len(s)
    want = float(np.max(np.abs(f(ref) - f(cur))))
    assert dr.ks_statistic(counts(spark, ref.tolist()), counts(spark, cur.tolist(), "w")).first()["ks_statistic"] == pytest.approx(want)


def test_ks_critical_and_severity(one):
    assert one(dr.ks_critical(F.col("n"), F.col("m")), n=100, m=100) == pytest.approx(0.19207, abs=1e-5)
    for psi, drifted, want in ((0.25, False, "alert"), (0.1, False, "warn"), (0.05, True, "warn"), (0.05, False, "none")):
        assert one(dr.severity(F.col("p"), F.col("d")), p=psi, d=drifted) == want


def test_drift_report(spark):
    rng = np.random.default_rng(4)
    make = lambda n, s, w: spark.createDataFrame(
        [(float(rng.normal(s, 1)), float(rng.normal(s, 1)), "a" if rng.random() < 0.5 else "b", w) for _ in range(n)],
        "x double, z double, c string, w string",
    )
    rows = dr.drift_report(make(800, 0, "r"), make(300, 0, "calm").unionAll(make(300, 2, "moved")), "w", ["x", "z"], ["c"]).collect()
    by = {(r["window"], r["feature"]): r for r in rows}
    assert len(rows) == 6 and by[("moved", "x")]["severity"] == "alert" and by[("moved", "c")]["retrain"]
    assert not by[("calm", "x")]["retrain"] and by[("calm", "c")]["ks_statistic"] is None


def decide(spark, auc, brier, incumbent):
    c = spark.createDataFrame([("m", "v2", auc, brier)], "line string, candidate string, auc double, brier double")
    i = spark.createDataFrame([("m", incumbent)] if incumbent is not None else [], "line string, auc double")
    r = pm.promotion_decisions(c, i, "line").first()
    return r["promote"], r["reasons"]


def test_promotion(spark):
    assert decide(spark, 0.755, 0.1, 0.75)[0] is True
    assert decide(spark, 0.754, 0.1, 0.75)[0] is False
    assert decide(spark, 0.9, 0.3, None) == (False, ["candidate brier 0.3000 above cap 0.20"])
    assert decide(spark, 0.71, 0.1, None) == (True, ["no production model - first promotion"])
    ok, reasons = decide(spark, 0.6, 0.3, 0.7)
    assert not ok and len(reasons) == 3


def test_promotion_figures_are_rounded_once(spark):
    values = [0.20984999999999, 0.69994999999999996, 0.69995, 0.00005, 1e-05, 0.49905, 0.5 + 0.00005, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(F.format_string("%.4f", "x")).collect()]
    assert got == [duckdb.execute(f"SELECT printf('%.4f', {_D('?::DOUBLE')})", [v]).fetchone()[0] for v in values]


def test_registry_state(spark):
    rows = [("a", 1, "promote", 1), ("a", 2, "promote", 2), ("a", 3, "reject", 9), ("a", 4, "rollback", 1), ("b", 1, "promote", 7), ("b", 2, "promote", 7)]
    log = spark.createDataFrame(rows, "model string, seq long, event string, version long")
    got = {r["model"]: (r["current_version"], r["rollback_target"]) for r in pm.registry_state(log).collect()}
    assert got == {"a": (1, 2), "b": (7, None)}
    moved = pm.rollback_events(log.where("model = 'a'"), "bad").first()
    assert (moved["version"], moved["previous_version"]) == (2, 1)
    with pytest.raises(Exception, match="nothing to roll back to"):
        pm.rollback_events(log, "bad").collect()


def test_histogram(spark):
    df = spark.createDataFrame([("a", 0.05), ("a", 0.1), ("a", 0.95), ("a", None)], "k string, v double")
    got = {r["le"]: r["observations"] for r in tm.histogram(df, ["k"], "v", tm.SCORE_EDGES).collect()}
    assert (got["0.0"], got["0.1"], got["0.9"], got["1.0"], got["+Inf"]) == (0, 2, 2, 3, 3)


def test_a_feature_without_values_is_an_alert(spark):
    ref = spark.createDataFrame([(float(i), "a", "r") for i in range(200)], "x double, c string, w string")
    cur = spark.createDataFrame([(None, None, "broken")] * 50 + [(float(i), "a", "fine") for i in range(200)], "x double, c string, w string")
    rows = {(r["w" if "w" in r.asDict() else "window"], r["feature"]): r for r in dr.drift_report(ref, cur, "w", ["x"], ["c"], retrain_alerts=1).collect()}
    assert len(rows) == 4 and rows["broken", "x"]["severity"] == "missing" and rows["broken", "x"]["psi"] is None
    assert rows["broken", "x"]["retrain"] and rows["fine", "x"]["severity"] == "none" and not rows["fine", "x"]["retrain"]
