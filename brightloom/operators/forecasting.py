"""Fitted forecasters over many series, and the whole forecasting job.

A forecaster (see ``functions.forecasters``) works on one training array. Spark spreads (series, fold) groups over the cluster; a
group never holds more than one series' days.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from brightloom.functions import fixed
from brightloom.functions.forecasters import FORECASTERS, BoostedSeries, Forecaster, ahead, holt_winters  # noqa: F401
from brightloom.operators import series as ts
from brightloom.session import checkpoint

def _forecast_groups(rows: DataFrame, keys: Sequence[str], models: Mapping[str, Forecaster], horizon: int) -> DataFrame:
    """Fit every model on each group's (ds, y) and forecast: (keys…, model, h, yhat)."""
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    chosen = dict(models)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        y, last = pdf["y"].to_numpy(dtype=float), pdf["ds"].iloc[-1]
        parts = [
            pd.DataFrame({"model": name, "h": np.arange(horizon, dtype=np.int32), "yhat": ahead(f, y, horizon, last)})
            for name, f in chosen.items()
        ]
        out = pd.concat(parts, ignore_index=True)
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "model", "h", "yhat"]]

    return rows.groupBy(*keys).applyInPandas(run, f"{types}, model string, h int, yhat double")


def fitted_backtest(
    grid: DataFrame, models: Mapping[str, Forecaster], horizon: int, n_folds: int, min_train: int
) -> DataFrame:
    """Rolling-origin predictions (series_id, fold, model, ds, y, yhat); each fit sees rows before its origin only."""
    numbered = ts._numbered(grid, horizon, n_folds, min_train)
    chosen = dict(models)
    kind = numbered.schema["series_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        y, fold = pdf["y"].to_numpy(dtype=float), pdf["fold"].fillna(-1).to_numpy(dtype=int)
        parts = []
        for k in range(n_folds):
            test = pdf[fold == k]
            origin = int(test["rn"].iloc[0])
            for name, f in chosen.items():
                part = test[["series_id", "ds", "y"]].copy()
                part["fold"], part["model"] = k, name
                part["yhat"] = ahead(f, y[:origin], horizon, pdf["ds"].iloc[origin - 1])
                parts.append(part)
        return pd.concat(parts, ignore_index=True)[["series_id", "fold", "model", "ds", "y", "yhat"]]

    # One group per series, all folds inside it: a training row moves once, not once per fold.
    rows = numbered.select("series_id", "rn", "fold", "ds", F.col("y").cast("double").alias("y"))
    return rows.groupBy("series_id").applyInPandas(run, f"series_id {kind}, fold int, model string, ds date, y double, yhat double")


def fitted_forecast(grid: DataFrame, models: Mapping[str, Forecaster], horizon: int) -> DataFrame:
    """Refit on all rows and forecast past the end: (series_id, model, ds, yhat)."""
    ends = grid.groupBy("series_id").agg(F.max("ds").alias("_end"))
    out = _forecast_groups(grid.select("series_id", "ds", "y"), ["series_id"], models, horizon)
    return out.join(ends, "series_id").select(
        "series_id", "model", F.expr("date_add(_end, h + 1)").alias("ds"), "yhat"
    )


# --- one boosted-tree model over all series; the job above fits one per series -------

_FEATURES = [
    *[f"lag_{k}" for k in fixed.LAGS],
    *[f"roll_{s}_{w}" for w in fixed.ROLL_WINDOWS for s in ("mean", "std")],
    "dayofweek", "month", "is_weekend", "is_month_start", "is_month_end", "doy_sin", "doy_cos",
]


def _array_features(ds: Column) -> dict[str, Column]:
    """The training features, read from a row's own array of its last days (newest last)."""
    out: dict[str, Column] = {f"lag_{k}": F.element_at("hist", -k) for k in fixed.LAGS}
    for w in fixed.ROLL_WINDOWS:
        tail = F.slice("hist", -w, w)
        mean = F.aggregate(tail, F.lit(0.0), lambda s, x: s + x) / w
        var = F.aggregate(tail, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / (w - 1)
        out[f"roll_mean_{w}"], out[f"roll_std_{w}"] = mean, F.sqrt(var)
    return {**out, **ts.calendar_columns(ds)}


def boosted_backtest(
    grid: DataFrame, horizon: int, n_folds: int, min_train: int, iterations: int = 300, depth: int = 5,
    learning_rate: float = 0.05, seed: int = 0, cut_every: int = 7,
) -> DataFrame:
    """Recursive multi-step forecasts of one global tree model per fold.

    The recursion carries one row per series whose array holds the last days,
    so a step is a narrow projection plus ``model.transform``: no shuffle. The
    lineage is cut through reliable storage every few steps.
    """
    numbered = checkpoint(ts._numbered(ts.features(grid), horizon, n_folds, min_train))
    assembler = VectorAssembler(inputCols=_FEATURES, outputCol="features")
    keep = max(max(fixed.LAGS), max(fixed.ROLL_WINDOWS))
    results = []
    for fold in range(n_folds):
        before = F.coalesce(F.col("fold"), F.lit(-1)) < fold
        train = assembler.transform(numbered.where(before).na.drop(subset=["y", *_FEATURES]))
        model = GBTRegressor(
            labelCol="y", maxIter=iterations, maxDepth=depth, stepSize=learning_rate, seed=seed
        ).fit(train.select("features", "y"))
        test = numbered.where(F.col("fold") == fold).select("series_id", "h", "ds", "y")
        origin = F.col("n_obs") - (n_folds - fold) * horizon
        state = (
            numbered.where(before & (F.col("rn") >= origin - keep))
            .groupBy("series_id")
            .agg(F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("_h"), F.max("ds").alias("_end"))
            .select("series_id", "_end", F.col("_h.y").alias("hist"), F.array().cast("array<double>").alias("out"))
        )
        for step in range(1, horizon + 1):
            ready = assembler.transform(state.withColumns(_array_features(F.date_add("_end", step))))
            state = model.transform(ready).select(
                "series_id", "_end",
                F.slice(F.array_append("hist", F.col("prediction")), -keep, keep).alias("hist"),
                F.array_append("out", F.col("prediction")).alias("out"),
            )
            if step % cut_every == 0 or step == horizon:
                state = checkpoint(state)
        ahead = state.select("series_id", F.posexplode("out").alias("h", "yhat"))
        results.append(
            test.join(ahead, ["series_id", "h"]).select(
                "series_id", F.lit(fold).alias("fold"), F.lit("boosted_trees").alias("model"), "ds", "y", "yhat"
            )
        )
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


# --- the whole job --------------------------------------------------------------------


def forecast_run(
    grid: DataFrame, models: Mapping[str, Forecaster], horizon: int, n_folds: int, min_train: int, alpha: float
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Backtest, select, calibrate, refit and forecast every series that has days enough.

    Returns (forecast rows with bounds, one summary row per series, rejected
    series with reasons). A series that cannot be modelled is reported and the
    others go on. The backtest is materialised once; all later steps read it.
    """
    rejected = ts.rejects(grid, min_train + n_folds * horizon)
    grid = grid.join(rejected.select("series_id"), "series_id", "left_anti")
    predictions = checkpoint(fitted_backtest(grid, models, horizon, n_folds, min_train))
    by_fold = ts.metrics(predictions, ts.fold_scales(grid, horizon, n_folds, min_train))
    winners = ts.best_models(by_fold)
    covered = ts.conformal_coverage(predictions.join(winners.select("series_id", "model"), ["series_id", "model"]), alpha)
    ahead = fitted_forecast(grid, models, horizon).join(winners.select("series_id", "model"), ["series_id", "model"])
    bounded = ts.apply_interval(ahead, covered, ["series_id", "model"])
    flagged = ts.anomaly_flags(grid).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if("is_anomaly").alias("n_anomalies")
    )
    summary = winners.join(covered, ["series_id", "model"]).join(flagged, "series_id")
    return bounded, summary, rejected
