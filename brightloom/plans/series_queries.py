"""Registered daily-series queries with their oracles (orders per priority and day)."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightloom.functions import fixed
from brightloom.operators import forecasting as fc, series as ts
from brightloom.sources.tables import table

HORIZON, N_FOLDS, MIN_TRAIN, ALPHA = 28, 5, 365, 0.1
# Grid values come from the same operations in both engines and are compared as they are;
# averages depend on the summation order and are rounded.
SEASONS = {"seasonal_naive_1": 1, "seasonal_naive_7": 7, "seasonal_naive_28": 28}
_LAYOUT = (HORIZON, N_FOLDS, MIN_TRAIN)


def _daily(spark, sf):
    orders = table(spark, sf, "orders")
    daily = ts.daily_totals(orders, "o_orderpriority", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)"))
    # thousands, summed exactly before the change to floating point
    return daily.withColumn("y", F.col("y").cast("double") / 1000)


def _grid(spark, sf):
    return ts.fill_gaps(_daily(spark, sf))


def _rounded(df, *names, digits=8):
    return df.withColumns({n: F.round(n, digits) for n in names})


def daily_series(spark, sf):
    return _rounded(_daily(spark, sf), "y")


def gap_fill(spark, sf):
    return _grid(spark, sf)


def lag_features(spark, sf):
    return _grid(spark, sf).withColumns(ts.lag_columns())


def rolling_features(spark, sf):
    out = _grid(spark, sf).withColumns(ts.rolling_columns()).drop("y")
    return _rounded(out, *[f"roll_{s}_{w}" for w in fixed.ROLL_WINDOWS for s in ("mean", "std")], digits=9)


def calendar_features(spark, sf):
    out = _grid(spark, sf).withColumns(ts.calendar_columns(F.col("ds"))).drop("y")
    return _rounded(out, "doy_sin", "doy_cos")


def training_table(spark, sf):
    out = ts.training_table(_grid(spark, sf))
    return out.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"),
        F.round(F.avg("lag_28"), 8).alias("mean_lag_28"), F.round(F.avg("roll_std_7"), 8).alias("mean_std_7"),
    )


def seasonal_naive(spark, sf):
    return ts.naive_forecast(_grid(spark, sf), HORIZON)


def backtest_folds(spark, sf):
    return ts.folds(_grid(spark, sf), *_LAYOUT)[0]


def backtest_naive(spark, sf):
    return ts.naive_backtest(_grid(spark, sf), SEASONS, *_LAYOUT)


def _fold_metrics(spark, sf):
    grid = _grid(spark, sf)
    return ts.metrics(ts.naive_backtest(grid, SEASONS, *_LAYOUT), ts.fold_scales(grid, *_LAYOUT))


def forecast_metrics(spark, sf):
    out = _fold_metrics(spark, sf).select("series_id", "fold", "model", "mae", "rmse", "smape", "mase")
    return _rounded(out, "mae", "rmse", "smape", "mase")


def model_selection(spark, sf):
    return _rounded(ts.model_ranking(_fold_metrics(spark, sf)), "mae", "rmse", "smape", "mase")


def _predictions(spark, sf):
    return ts.naive_backtest(_grid(spark, sf), SEASONS, *_LAYOUT)


def conformal_width(spark, sf):
    residuals = _predictions(spark, sf).withColumn("residual", F.col("y") - F.col("yhat"))
    return _rounded(ts.conformal_width(residuals, ALPHA), "half_width")


def forecast_intervals(spark, sf):
    grid = _grid(spark, sf)
    residuals = ts.naive_backtest(grid, {"seasonal_naive_7": 7}, *_LAYOUT).withColumn("residual", F.col("y") - F.col("yhat"))
    ahead = ts.naive_forecast(grid, HORIZON, 7)
    out = ts.apply_interval(ahead, ts.conformal_width(residuals, ALPHA, ["series_id"]), ["series_id"])
    return _rounded(out.select("series_id", "ds", "yhat", "lower", "upper"), "yhat", "lower", "upper")


def mase_pivot(spark, sf):
    return _rounded(ts.metric_pivot(_fold_metrics(spark, sf), list(SEASONS)), *SEASONS)


def conformal_coverage(spark, sf):
    return _rounded(ts.conformal_coverage(_predictions(spark, sf), ALPHA), "half_width", "coverage")


def anomaly_flags(spark, sf):
    return _rounded(ts.anomaly_flags(_grid(spark, sf)), "zscore")


def ets_backtest(spark, sf):
    return fc.fitted_backtest(_grid(spark, sf), {"exp_smoothing": fc.holt_winters}, *_LAYOUT)


def gbt_backtest(spark, sf):
    return fc.fitted_backtest(_grid(spark, sf), {"boosted_trees": fc.BoostedSeries()}, *_LAYOUT)


def _by_customer(spark, sf):
    return ts.daily_totals(table(spark, sf, "orders"), "o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)"))


def series_rejects(spark, sf):
    """Customers whose orders span too few days for the backtest."""
    return ts.rejects(_by_customer(spark, sf), MIN_TRAIN + N_FOLDS * HORIZON)


def duplicate_days(spark, sf):
    """Days with more than one order of a customer."""
    days = table(spark, sf, "orders").select(F.col("o_custkey").alias("series_id"), F.to_date("o_orderdate").alias("ds"))
    return ts.duplicate_days(days)


def forecast_run(spark, sf):
    return fc.forecast_run(_grid(spark, sf), fc.FORECASTERS, *_LAYOUT, ALPHA)[0]


def forecast_summary(spark, sf):
    return fc.forecast_run(_grid(spark, sf), fc.FORECASTERS, *_LAYOUT, ALPHA)[1]


QUERIES = {
    f.__name__: f
    for f in (
        daily_series, gap_fill, lag_features, rolling_features, calendar_features, training_table, seasonal_naive,
        backtest_folds, backtest_naive, forecast_metrics, model_selection, conformal_width, forecast_intervals,
        mase_pivot, conformal_coverage, anomaly_flags, ets_backtest, gbt_backtest, forecast_run, forecast_summary,
        series_rejects, duplicate_days,
    )
}

# --- oracles ---------------------------------------------------------------------------

_DAILY = """
daily AS (SELECT o_orderpriority AS series_id, o_orderdate::DATE AS ds,
  sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 1000 AS y FROM orders GROUP BY 1, 2)"""
_GRID = _DAILY + """,
days AS (SELECT series_id, unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY))::DATE AS ds FROM daily GROUP BY 1),
known AS (SELECT s.series_id, s.ds, d.y, CASE WHEN d.y IS NOT NULL THEN s.ds END AS kd
  FROM days s LEFT JOIN daily d ON d.series_id = s.series_id AND d.ds = s.ds),
sides AS (SELECT *, last_value(y IGNORE NULLS) OVER p AS y0, last_value(kd IGNORE NULLS) OVER p AS d0,
  first_value(y IGNORE NULLS) OVER q AS y1, first_value(kd IGNORE NULLS) OVER q AS d1 FROM known
  WINDOW p AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         q AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
grid AS (SELECT series_id, ds, CASE WHEN y IS NOT NULL THEN y WHEN d1 IS NULL THEN y0
  ELSE y0 + (y1 - y0) * ((ds - d0)::DOUBLE / (d1 - d0)) END AS y FROM sides)"""
_ROLL = ", ".join(
    f"CASE WHEN count(y) OVER w{w} = {w} THEN avg(y) OVER w{w} END AS roll_mean_{w}, "
    f"CASE WHEN count(y) OVER w{w} = {w} THEN stddev_samp(y) OVER w{w} END AS roll_std_{w}"
    for w in fixed.ROLL_WINDOWS
)
_ROLL_WINDOW = ", ".join(
    f"w{w} AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in fixed.ROLL_WINDOWS
)
_LAG = ", ".join(f"lag(y, {k}) OVER (PARTITION BY series_id ORDER BY ds) AS lag_{k}" for k in fixed.LAGS)
_FOLDS = _GRID + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS rn,
  count(*) OVER (PARTITION BY series_id) AS n FROM grid),
folds AS (SELECT DISTINCT series_id, f::INT AS fold, (n - ({N_FOLDS} - f) * {HORIZON})::BIGINT AS origin
  FROM numbered, range({N_FOLDS}) r(f) WHERE n >= {MIN_TRAIN + N_FOLDS * HORIZON})"""
_PRED = _FOLDS + """,
pred AS (""" + " UNION ALL ".join(
    f"""SELECT t.series_id, f.fold, '{m}' AS model, t.ds, t.y, s.y AS yhat
  FROM folds f JOIN numbered t ON t.series_id = f.series_id AND t.rn >= f.origin AND t.rn < f.origin + {HORIZON}
  JOIN numbered s ON s.series_id = f.series_id AND s.rn = f.origin - {p} + (t.rn - f.origin) % {p}"""
    for m, p in SEASONS.items()
) + ")"
_METRICS = _PRED + """,
diffs AS (SELECT series_id, rn, abs(y - lag(y, 7) OVER (PARTITION BY series_id ORDER BY ds)) AS d FROM numbered),
scales AS (SELECT f.series_id, f.fold, avg(d) AS scale FROM folds f JOIN diffs x ON x.series_id = f.series_id AND x.rn < f.origin GROUP BY 1, 2),
m AS (SELECT p.series_id, p.fold, model, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
  100 * avg(CASE WHEN abs(y) + abs(yhat) = 0 THEN 0 ELSE 2 * abs(y - yhat) / (abs(y) + abs(yhat)) END) AS smape,
  avg(abs(y - yhat)) / any_value(scale) AS mase
  FROM pred p JOIN scales s ON s.series_id = p.series_id AND s.fold = p.fold GROUP BY 1, 2, 3)"""


def _width(source: str, keys: str) -> str:
    return f"""
ranked AS (SELECT {keys}, abs(y - yhat) AS a, row_number() OVER (PARTITION BY {keys} ORDER BY abs(y - yhat)) AS r,
  count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
widths AS (SELECT {keys}, max(a) FILTER (r = ceil(ceil((n + 1) * {1 - ALPHA}::DOUBLE) / n * (n - 1)) + 1
  AND (n + 1) * {1 - ALPHA}::DOUBLE <= n) AS half_width, max(n) AS n_calibration FROM ranked GROUP BY {keys})"""


ORACLES = {
    "series_rejects": f"""WITH d AS (SELECT o_custkey AS series_id, min(o_orderdate::DATE) AS lo, max(o_orderdate::DATE) AS hi FROM orders GROUP BY 1)
SELECT series_id, (hi - lo + 1)::BIGINT AS n_obs, 'needs {MIN_TRAIN + N_FOLDS * HORIZON} days, has ' || (hi - lo + 1) AS reason
FROM d WHERE hi - lo + 1 < {MIN_TRAIN + N_FOLDS * HORIZON}""",
    "duplicate_days": """SELECT o_custkey AS series_id, o_orderdate::DATE AS ds, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1""",
    "daily_series": f"WITH {_DAILY} SELECT series_id, ds, round(y, 8) AS y FROM daily",
    "gap_fill": f"WITH {_GRID} SELECT series_id, ds, y FROM grid",
    "lag_features": f"WITH {_GRID}, l AS (SELECT *, {_LAG} FROM grid) SELECT series_id, ds, y, "
    + ", ".join(f"lag_{k}" for k in fixed.LAGS) + " FROM l",
    "rolling_features": f"WITH {_GRID}, r AS (SELECT *, {_ROLL} FROM grid WINDOW {_ROLL_WINDOW}) SELECT series_id, ds, "
    + ", ".join(f"round(roll_{s}_{w}, 9) AS roll_{s}_{w}" for w in fixed.ROLL_WINDOWS for s in ("mean", "std")) + " FROM r",
    "calendar_features": f"""WITH {_GRID} SELECT series_id, ds, isodow(ds) - 1 AS dayofweek, month(ds) AS month,
  (isodow(ds) >= 6)::INT AS is_weekend, (day(ds) = 1)::INT AS is_month_start, (ds = last_day(ds))::INT AS is_month_end,
  round(sin(2 * pi() * dayofyear(ds) / 365.25), 8) AS doy_sin, round(cos(2 * pi() * dayofyear(ds) / 365.25), 8) AS doy_cos
  FROM grid""",
    "training_table": f"""WITH {_GRID}, r AS (SELECT *, {_LAG}, {_ROLL} FROM grid WINDOW {_ROLL_WINDOW})
SELECT series_id, count(*) AS rows, min(ds) AS first_ds, max(ds) AS last_ds, round(avg(lag_28), 8) AS mean_lag_28,
  round(avg(roll_std_7), 8) AS mean_std_7 FROM r WHERE lag_28 IS NOT NULL AND roll_std_28 IS NOT NULL GROUP BY 1""",
    "seasonal_naive": f"""WITH {_FOLDS}, h AS (SELECT unnest(range(1, {HORIZON + 1})) AS h),
last AS (SELECT series_id, max(ds) AS e, max(n) AS n FROM numbered GROUP BY 1)
SELECT l.series_id, (l.e + h::INT)::DATE AS ds, s.y AS yhat FROM last l, h
JOIN numbered s ON s.rn = n - 7 + (h - 1) % 7 AND s.series_id = l.series_id""",
    "backtest_folds": f"""WITH {_FOLDS} SELECT series_id, fold, origin AS train_end, origin AS test_start,
  origin + {HORIZON} AS test_end FROM folds""",
    "backtest_naive": f"WITH {_PRED} SELECT series_id, fold, model, ds, y, yhat FROM pred",
    "forecast_metrics": f"""WITH {_METRICS} SELECT series_id, fold, model, round(mae, 8) AS mae, round(rmse, 8) AS rmse,
  round(smape, 8) AS smape, round(mase, 8) AS mase FROM m""",
    "model_selection": f"""WITH {_METRICS}, a AS (SELECT series_id, model, avg(mae) AS mae, avg(rmse) AS rmse, avg(smape) AS smape,
  avg(mase) AS mase FROM m GROUP BY 1, 2)
SELECT series_id, model, round(mae, 8) AS mae, round(rmse, 8) AS rmse, round(smape, 8) AS smape, round(mase, 8) AS mase,
  row_number() OVER (PARTITION BY series_id ORDER BY a.mase, model)::INT AS rank FROM a""",
    "conformal_width": f"WITH {_PRED}, {_width('pred', 'series_id, model')} SELECT series_id, model, round(half_width, 8) AS half_width, n_calibration FROM widths",
    "forecast_intervals": f"""WITH {_PRED}, p7 AS (SELECT * FROM pred WHERE model = 'seasonal_naive_7'), {_width('p7', 'series_id')},
h AS (SELECT unnest(range(1, {HORIZON + 1})) AS h), last AS (SELECT series_id, max(ds) AS e, max(n) AS n FROM numbered GROUP BY 1)
SELECT l.series_id, (l.e + h::INT)::DATE AS ds, round(s.y, 8) AS yhat, round(s.y - half_width, 8) AS lower,
  round(s.y + half_width, 8) AS upper FROM last l, h
JOIN numbered s ON s.rn = n - 7 + (h - 1) % 7 AND s.series_id = l.series_id JOIN widths w ON w.series_id = l.series_id""",
    "mase_pivot": f"WITH {_METRICS} SELECT series_id, fold, "
    + ", ".join(f"round(max(mase) FILTER (model = '{m}'), 8) AS {m}" for m in SEASONS) + " FROM m GROUP BY 1, 2",
    "conformal_coverage": f"""WITH {_PRED}, cal AS (SELECT * FROM pred WHERE fold < {N_FOLDS - 1}), {_width('cal', 'series_id, model')}
SELECT p.series_id, p.model, round(any_value(half_width), 8) AS half_width, any_value(n_calibration) AS n_calibration,
  round(avg((abs(y - yhat) <= half_width)::INT), 8) AS coverage
FROM pred p JOIN widths w ON w.series_id = p.series_id AND w.model = p.model WHERE fold = {N_FOLDS - 1} GROUP BY 1, 2""",
    "anomaly_flags": f"""WITH {_GRID},
r AS (SELECT *, y - lag(y, 7) OVER (PARTITION BY series_id ORDER BY ds) AS e FROM grid),
q AS (SELECT *, CASE WHEN count(e) OVER w >= 28 THEN quantile_cont(e, 0.5) OVER w END AS med FROM r
  WINDOW w AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 55 PRECEDING AND CURRENT ROW)),
d AS (SELECT *, abs(e - med) AS dev FROM q),
s AS (SELECT *, CASE WHEN count(dev) OVER w >= 28 THEN quantile_cont(dev, 0.5) OVER w END AS mad FROM d
  WINDOW w AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 55 PRECEDING AND CURRENT ROW)),
z AS (SELECT series_id, ds, y, (e - med) / nullif({fixed.MAD_TO_SIGMA} * mad, 0) AS zscore FROM s)
SELECT series_id, ds, y, round(zscore, 8) AS zscore, coalesce(abs(zscore) > 3, false) AS is_anomaly FROM z""",
}
