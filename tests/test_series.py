import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.functions import fixed, forecasters
from brightloom.functions.forecasters import holt_winters
from brightloom.operators import forecasting as fc, series as ts

DAY0 = dt.date(2023, 1, 1)


def make(spark, values, name="s", skip=()):
    rows = [(name, DAY0 + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, "series_id string, ds date, y double")


def ys(df, c="y"):
    return [r[c] for r in df.orderBy("series_id", "ds").collect()]


def seasonal(n, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 100 + 0.05 * t + 10 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 1, n)


def test_gap_fill(spark):
    df = make(spark, [None, 2, 0, 0, 8, 5, None, None], skip={2, 3})
    assert ys(ts.fill_gaps(df)) == [None, 2.0, 4.0, 6.0, 8.0, 5.0, 5.0, 5.0]


def test_duplicates(spark):
    df = make(spark, [1, 2]).unionAll(make(spark, [3]))
    assert ts.duplicate_days(df).count() == 1


def test_features_use_the_past_only(spark):
    values = list(seasonal(60))
    base = ts.features(make(spark, values)).orderBy("ds").collect()
    assert base[20]["roll_mean_7"] == pytest.approx(np.mean(values[13:20]))
    assert base[20]["roll_std_7"] == pytest.approx(np.std(values[13:20], ddof=1))
    assert base[20]["lag_14"] == values[6] and base[6]["roll_mean_7"] is None
    broken = ts.features(make(spark, values[:40] + [1e9] * 20)).orderBy("ds").collect()
    drop = lambda r: {k: v for k, v in r.asDict().items() if k != "y"}
    assert [drop(r) for r in base[:41]] == [drop(r) for r in broken[:41]]


def test_training_rows(spark):
    assert ts.training_table(make(spark, range(90))).count() == 62


def test_calendar(spark):
    row = spark.range(1).select(F.lit(dt.date(2024, 6, 30)).alias("d")).select(
        *[c.alias(n) for n, c in ts.calendar_columns(F.col("d")).items()]
    ).first()
    assert (row["dayofweek"], row["month"], row["is_weekend"], row["is_month_start"], row["is_month_end"]) == (6, 6, 1, 0, 1)
    assert row["doy_sin"] == pytest.approx(math.sin(2 * math.pi * 182 / 365.25))


def test_folds(spark):
    rows, bad = ts.folds(make(spark, range(400)), 30, 4, 200)
    got = [(r["fold"], r["train_end"], r["test_end"]) for r in rows.orderBy("fold").collect()]
    assert got == [(0, 280, 310), (1, 310, 340), (2, 340, 370), (3, 370, 400)] and bad.count() == 0
    rows, bad = ts.folds(make(spark, range(100)), 30, 4, 200)
    assert rows.count() == 0 and bad.first()["n_obs"] == 100


def test_naive_backtest_matches_a_loop(spark):
    values = list(seasonal(150))
    got = ts.naive_backtest(make(spark, values), {"m": 7}, 10, 3, 60).orderBy("ds").collect()
    want = []
    for fold in range(3):
        end = 150 - (3 - fold) * 10
        want += [values[end - 7 + h % 7] for h in range(10)]
    assert [r["yhat"] for r in got] == want and [r["y"] for r in got] == values[120:]


def test_metrics(spark):
    rows = [("s", 0, "m", DAY0, 1.0, 2.0), ("s", 0, "m", DAY0, 2.0, 2.0), ("s", 0, "m", DAY0, 4.0, 2.0)]
    pred = spark.createDataFrame(rows, "series_id string, fold int, model string, ds date, y double, yhat double")
    scales = spark.createDataFrame([("s", 0, 2.0)], "series_id string, fold int, scale double")
    r = ts.metrics(pred, scales).first()
    assert r["mae"] == pytest.approx(1.0) and r["rmse"] == pytest.approx(math.sqrt(5 / 3)) and r["mase"] == pytest.approx(0.5)
    zero = pred.withColumns({"y": F.lit(0.0), "yhat": F.lit(0.0)})
    assert ts.metrics(zero, scales).first()["smape"] == 0.0


def test_constant_series_has_no_scale(spark):
    assert [r["scale"] for r in ts.fold_scales(make(spark, [5] * 100), 10, 2, 50).collect()] == [None, None]


def test_conformal(spark):
    rows = [("s", "m", float(i)) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "series_id string, model string, residual double")
    r = ts.conformal_width(df, 0.2).first()
    assert r["half_width"] == 10.0 and r["n_calibration"] == 10
    assert ts.conformal_width(df.limit(3), 0.1).first()["half_width"] is None


def test_conformal_coverage_is_close_to_nominal(spark):
    rng = np.random.default_rng(3)
    rows = [("s", f, "m", DAY0 + dt.timedelta(days=f * 500 + i), float(e), 0.0) for f in range(5) for i, e in enumerate(rng.normal(0, 1, 400))]
    pred = spark.createDataFrame(rows, "series_id string, fold int, model string, ds date, y double, yhat double")
    assert ts.conformal_coverage(pred, 0.1).first()["coverage"] == pytest.approx(0.9, abs=0.04)


def test_anomalies(spark):
    values = seasonal(300)
    clean = ts.anomaly_flags(make(spark, values))
    assert clean.where("is_anomaly").count() / 300 < 0.03
    values[200] += 60
    flagged = ts.anomaly_flags(make(spark, values)).where("is_anomaly").select("ds").collect()
    assert DAY0 + dt.timedelta(days=200) in [r["ds"] for r in flagged]


def test_holt_winters_beats_naive(spark):
    grid = make(spark, seasonal(260)).unionAll(make(spark, seasonal(260, 5), "t"))
    pred = fc.fitted_backtest(grid, {m: fc.FORECASTERS[m] for m in ("seasonal_naive", "exp_smoothing")}, 14, 3, 100)
    assert pred.count() == 2 * 2 * 3 * 14
    best = ts.best_models(ts.metrics(pred, ts.fold_scales(grid, 14, 3, 100)))
    assert {r["model"] for r in best.collect()} == {"exp_smoothing"}
    with pytest.raises(ValueError):
        holt_winters(np.arange(10.0), 3)


def test_fitted_backtest_never_sees_the_future(spark):
    seen = {}

    def spy(y, horizon):
        return np.full(horizon, y[-1])

    values = list(range(100))
    pred = fc.fitted_backtest(make(spark, values), {"last": spy}, 10, 3, 50).orderBy("ds").collect()
    assert [r["yhat"] for r in pred] == [69.0] * 10 + [79.0] * 10 + [89.0] * 10 and not seen


def test_forecast_run(spark):
    grid = make(spark, seasonal(200))
    short = make(spark, seasonal(40), "short").unionAll(make(spark, seasonal(10), "tiny")).unionAll(make(spark, [None] * 200, "empty"))
    ahead, summary, rejected = fc.forecast_run(grid.unionAll(short), fc.FORECASTERS, 14, 3, 100, 0.2)
    assert {(r["series_id"], r["reason"]) for r in rejected.collect()} == {
        ("short", "needs 142 days, has 40"), ("tiny", "needs 142 days, has 10"), ("empty", "no values")}
    rows = ahead.orderBy("ds").collect()
    assert len(rows) == 14 and rows[0]["ds"] == DAY0 + dt.timedelta(days=200)
    assert all(r["lower"] < r["yhat"] < r["upper"] for r in rows)
    s = summary.first()
    assert s["n_days"] == 200 and 0 <= s["coverage"] <= 1 and s["model"] == rows[0]["model"]


def test_every_model_can_win(spark):
    """A seasonal random walk, a trend with a weekly wave, and fortnights that neither of the other models can see."""
    rng, t = np.random.default_rng(5), np.arange(420)
    walk = rng.normal(50, 20, 420)
    for i in range(7, 420):
        walk[i] = walk[i - 7] + rng.normal(0, 2)
    smooth = 100 + 0.3 * t + 10 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 3, 420)
    blocks = 20 + 30 * (t // 7 % 2) + rng.normal(0, 1, 420)
    grid = make(spark, walk, "walk").unionAll(make(spark, smooth, "smooth")).unionAll(make(spark, blocks, "blocks"))
    ahead, summary, rejected = fc.forecast_run(grid, fc.FORECASTERS, 28, 3, 200, 0.2)
    won = {r["series_id"]: r["model"] for r in summary.collect()}
    assert won == {"walk": "seasonal_naive", "smooth": "exp_smoothing", "blocks": "boosted_trees"} and rejected.count() == 0
    rows = [r for r in ahead.orderBy("ds").collect() if r["series_id"] == "blocks"]
    assert len(rows) == 28 and all(abs(r["yhat"] - (20 + 30 * ((420 + i) // 7 % 2))) < 5 for i, r in enumerate(rows))


def test_boosted_features_are_those_of_the_training_table(spark):
    values, seen = seasonal(120), ts.features(make(spark, seasonal(120))).orderBy("ds").collect()
    days, at = np.datetime64(DAY0, "D") + np.arange(120), np.arange(28, 120)
    got = np.hstack([forecasters._past(values, at), forecasters._calendar(days)[at]])
    names = [*[f"lag_{k}" for k in fixed.LAGS], *[f"roll_{s}_{w}" for w in fixed.ROLL_WINDOWS for s in ("mean", "std")],
             "dayofweek", "month", "is_weekend", "is_month_start", "is_month_end", "doy_sin", "doy_cos"]
    assert got == pytest.approx(np.array([[float(seen[i][c]) for c in names] for i in at]))
    with pytest.raises(ValueError, match="need"):
        fc.BoostedSeries()(values[:40], 3, DAY0)


def test_boosted_backtest(spark):
    grid = make(spark, seasonal(160)).unionAll(make(spark, seasonal(160, 9), "t"))
    pred = fc.boosted_backtest(grid, 7, 1, 100, iterations=5, cut_every=4)
    assert pred.count() == 14
    err = pred.select(F.avg(F.abs(F.col("y") - F.col("yhat")))).first()[0]
    assert err < 6  # a flat forecast is off by about 6.4 on this wave


def test_a_series_without_values_stays(spark):
    filled = ts.fill_gaps(make(spark, [None, None], "none").unionAll(make(spark, [1.0, None, 3.0], "some")))
    got = sorted((r["series_id"], r["y"] is None) for r in filled.collect())
    assert got == [("none", True)] * 2 + [("some", False)] * 3
