"""Daily series: grid, leak-free features, backtests, intervals, anomalies.

A series is (series_id, ds, y). Raw events are summed to days before anything
is ordered, so a partition of the windows below never holds more rows than a
series has days, however many events feed it. All steps keep the same window
partitioning, so a chain of them shuffles once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightloom.functions import fixed
from brightloom.functions.ranking import top_k



def _series():
    return Window.partitionBy("series_id")


def _by_day():
    return _series().orderBy("ds")


def daily_totals(events: DataFrame, series: str, ts: str, value: Column) -> DataFrame:
    """Sum raw events to (series_id, ds, y); combined on the map side."""
    return events.groupBy(F.col(series).alias("series_id"), F.to_date(ts).alias("ds")).agg(F.sum(value).alias("y"))


def duplicate_days(df: DataFrame) -> DataFrame:
    """Days that occur more than once in pre-aggregated input."""
    return df.groupBy("series_id", "ds").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def fill_gaps(daily: DataFrame) -> DataFrame:
    """Full daily grid from first to last day, straight-line values in the gaps.

    Each known day emits itself and the missing days up to the next known one,
    so no grid table and no join is needed. After the last known value it is
    carried forward; days before the first known value stay null, and so do all
    days of a series without any value.
    """
    spanned = daily.withColumn("_lo", F.min("ds").over(_series())).withColumn("_hi", F.max("ds").over(_series()))
    known = (
        spanned.where(F.col("y").isNotNull())
        .withColumn("_next", F.lead("ds").over(_by_day()))
        .withColumn("_y1", F.lead("y").over(_by_day()))
        .withColumn("_first", F.row_number().over(_by_day()) == 1)
    )
    stop = F.coalesce(F.date_sub("_next", 1), "_hi")
    gap = F.datediff("_next", "ds")
    own = F.transform(
        F.sequence("ds", stop),
        lambda d: F.struct(
            d.alias("ds"),
            F.when(d == F.col("ds"), F.col("y"))
            .when(F.col("_next").isNull(), F.col("y"))
            .otherwise(F.col("y") + (F.col("_y1") - F.col("y")) * (F.datediff(d, "ds") / gap))
            .alias("y"),
        ),
    )
    lead_in = F.when(
        F.col("_first") & (F.col("_lo") < F.col("ds")),
        F.transform(
            F.sequence("_lo", F.date_sub("ds", 1)),
            lambda d: F.struct(d.alias("ds"), F.lit(None).cast("double").alias("y")),
        ),
    ).otherwise(F.array().cast("array<struct<ds:date,y:double>>"))
    filled = known.select("series_id", F.explode(F.concat(lead_in, own)).alias("p")).select("series_id", "p.ds", "p.y")
    spans = daily.groupBy("series_id").agg(F.min("ds").alias("_lo"), F.max("ds").alias("_hi"), F.count("y").alias("_known"))
    unknown = spans.where("_known = 0 and _lo is not null").select(
        "series_id", F.explode(F.sequence("_lo", "_hi")).alias("ds"), F.lit(None).cast(daily.schema["y"].dataType).alias("y")
    )
    return filled.unionByName(unknown)


def rejects(daily: DataFrame, needed: int) -> DataFrame:
    """(series_id, n_obs, reason) of the series that a job over ``needed`` days cannot take.

    ``n_obs`` counts days from the first to the last. Sums combine on the map
    side; no series is gathered.
    """
    spans = daily.groupBy("series_id").agg(
        F.min("ds").alias("lo"), F.max("ds").alias("hi"), F.count("y").alias("known"),
        F.min(F.when(F.col("y").isNotNull(), F.col("ds"))).alias("first"),
    ).withColumn("n_obs", F.coalesce(F.datediff("hi", "lo") + 1, F.lit(0)).cast("long"))
    reason = (
        F.when(F.col("known") == 0, "no values")
        .when(F.col("n_obs") < needed, F.concat(F.lit(f"needs {needed} days, has "), F.col("n_obs").cast("string")))
        .when(F.col("first") > F.col("lo"), "no value on the first day")
    )
    return spans.select("series_id", "n_obs", reason.alias("reason")).where("reason is not null")


def calendar_columns(ds: Column) -> dict[str, Column]:
    angle = F.dayofyear(ds) * 2.0 * 3.141592653589793 / fixed.DAYS_PER_YEAR
    return {
        "dayofweek": F.weekday(ds),
        "month": F.month(ds),
        "is_weekend": (F.weekday(ds) >= 5).cast("int"),
        "is_month_start": (F.dayofmonth(ds) == 1).cast("int"),
        "is_month_end": (ds == F.last_day(ds)).cast("int"),
        "doy_sin": F.sin(angle),
        "doy_cos": F.cos(angle),
    }


def lag_columns(lags: Sequence[int] = fixed.LAGS) -> dict[str, Column]:
    return {f"lag_{k}": F.lag("y", k).over(_by_day()) for k in lags}


def rolling_columns(windows: Sequence[int] = fixed.ROLL_WINDOWS) -> dict[str, Column]:
    """Mean and sample deviation of the ``w`` days before the current one; null until full."""
    out: dict[str, Column] = {}
    for w in windows:
        past = _by_day().rowsBetween(-w, -1)
        full = F.count("y").over(past) == w
        out[f"roll_mean_{w}"] = F.when(full, F.avg("y").over(past))
        out[f"roll_std_{w}"] = F.when(full, F.stddev_samp("y").over(past))
    return out


def features(grid: DataFrame, lags: Sequence[int] = fixed.LAGS, windows: Sequence[int] = fixed.ROLL_WINDOWS) -> DataFrame:
    return grid.withColumns({**lag_columns(lags), **rolling_columns(windows), **calendar_columns(F.col("ds"))})


def training_table(grid: DataFrame) -> DataFrame:
    """Feature rows without any null."""
    return features(grid).na.drop()


# --- folds and backtests -----------------------------------------------------------


def folds(grid: DataFrame, horizon: int, n_folds: int, min_train: int) -> tuple[DataFrame, DataFrame]:
    """Expanding-window folds per series, and the series too short for them.

    The last test window ends at the last row; bounds are row numbers from 0,
    ends exclusive.
    """
    needed = min_train + n_folds * horizon
    sizes = grid.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_obs"))
    rows = (
        sizes.where(F.col("n_obs") >= needed)
        .select("series_id", "n_obs", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
        .withColumn("test_end", F.col("n_obs") - (n_folds - 1 - F.col("fold")) * horizon)
        .withColumn("test_start", F.col("test_end") - horizon)
        .select("series_id", "fold", F.col("test_start").alias("train_end"), "test_start", "test_end")
    )
    rejected = sizes.where(F.col("n_obs") < needed).select(
        "series_id", "n_obs", F.lit(f"needs {needed} rows").alias("reason")
    )
    return rows, rejected


def _numbered(grid: DataFrame, horizon: int, n_folds: int, min_train: int) -> DataFrame:
    """Rows of long enough series with ``rn``, ``n_obs``, ``fold`` (null = training only) and ``h``."""
    numbered = (
        grid.withColumn("rn", F.row_number().over(_by_day()) - 1)
        .withColumn("n_obs", F.count(F.lit(1)).over(_series()))
        .where(F.col("n_obs") >= min_train + n_folds * horizon)
    )
    back = F.floor((F.col("n_obs") - 1 - F.col("rn")) / horizon)
    return numbered.withColumn("fold", F.when(back < n_folds, (n_folds - 1 - back).cast("int"))).withColumn(
        "h", F.when(back < n_folds, ((horizon - 1) - (F.col("n_obs") - 1 - F.col("rn")) % horizon).cast("int"))
    )


def naive_backtest(
    grid: DataFrame,
    seasons: Mapping[str, int],
    horizon: int,
    n_folds: int,
    min_train: int,
) -> DataFrame:
    """Seasonal-naive predictions for every fold: (series_id, fold, model, ds, y, yhat).

    The value ``season`` steps before the origin cycle is a fixed lag of the
    test row (1, 2, … whole seasons), so one window produces all models and
    folds and nothing after the origin can enter a forecast.
    """
    rows = _numbered(grid, horizon, n_folds, min_train)
    forecasts = []
    for model, season in seasons.items():
        lags = [F.lag("y", season * (c + 1)).over(_by_day()) for c in range(-(-horizon // season))]
        cycle = (F.floor(F.col("h") / season) + 1).cast("int")
        forecasts.append(F.struct(F.lit(model).alias("model"), F.element_at(F.array(*lags), cycle).alias("yhat")))
    # The windows must see training rows too, so they are computed before the test rows are cut out.
    wide = rows.withColumns({f"_m{i}": f for i, f in enumerate(forecasts)}).where(F.col("fold").isNotNull())
    return wide.select(
        "series_id", "fold", "ds", "y", F.explode(F.array(*[f"_m{i}" for i in range(len(forecasts))])).alias("m")
    ).select("series_id", "fold", "m.model", "ds", "y", "m.yhat")


def naive_forecast(grid: DataFrame, horizon: int, season: int = fixed.SEASON) -> DataFrame:
    """Repeat the last full cycle ``horizon`` days past each series; shorter series give no rows."""
    last = (
        grid.withColumn("_back", F.row_number().over(_series().orderBy(F.desc("ds"))))
        .withColumn("_end", F.max("ds").over(_series()))
        .withColumn("_n", F.count(F.lit(1)).over(_series()))
        .where((F.col("_back") <= season) & (F.col("_n") >= season))
    )
    step = F.sequence(F.lit(0), F.lit((horizon - 1) // season))
    steps = last.select(
        "series_id", "_end", F.explode(F.transform(step, lambda c: c * season + season - F.col("_back") + 1)).alias("h"), "y"
    )
    return steps.where(F.col("h") <= horizon).select(
        "series_id", F.expr("date_add(_end, cast(h as int))").alias("ds"), F.col("y").alias("yhat")
    )


def fold_scales(grid: DataFrame, horizon: int, n_folds: int, min_train: int, season: int = fixed.SEASON) -> DataFrame:
    """In-sample seasonal-naive MAE of each fold's training rows; null when undefined."""
    rows = _numbered(grid, horizon, n_folds, min_train).withColumn(
        "_d", F.abs(F.col("y") - F.lag("y", season).over(_by_day()))
    )
    so_far = _by_day().rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_s", F.sum("_d").over(so_far)).withColumn("_c", F.count("_d").over(so_far))
        .where(F.col("h") == 0)
        .select("series_id", "fold", F.try_divide("_s", "_c").alias("_m"))
        .select("series_id", "fold", F.when(F.col("_m") != 0, F.col("_m")).alias("scale"))
    )


def metrics(predictions: DataFrame, scales: DataFrame) -> DataFrame:
    """MAE, RMSE, sMAPE (percent, 0/0 counts as 0) and MASE per (series_id, fold, model)."""
    err = F.abs(F.col("y") - F.col("yhat"))
    size = F.abs("y") + F.abs("yhat")
    grouped = predictions.groupBy("series_id", "fold", "model").agg(
        F.avg(err).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.when(size == 0, F.lit(0.0)).otherwise(F.try_divide(err * 2.0, size))) * 100.0).alias("smape"),
    )
    return grouped.join(scales, ["series_id", "fold"], "left").withColumn("mase", F.try_divide("mae", "scale"))


def model_ranking(fold_metrics: DataFrame, metric: str = "mase") -> DataFrame:
    """Mean metrics over folds with ``rank`` 1 for the lowest mean of ``metric``."""
    means = fold_metrics.groupBy("series_id", "model").agg(
        *[F.avg(m).alias(m) for m in ("mae", "rmse", "smape", "mase")]
    )
    order = _series().orderBy(F.asc_nulls_last(metric), "model")
    return means.withColumn("rank", F.row_number().over(order))


def metric_pivot(fold_metrics: DataFrame, models: Sequence[str], metric: str = "mase") -> DataFrame:
    return fold_metrics.groupBy("series_id", "fold").pivot("model", list(models)).agg(F.first(metric))


# --- conformal intervals -----------------------------------------------------------


def conformal_width(residuals: DataFrame, alpha: float, keys: Sequence[str] = ("series_id", "model")) -> DataFrame:
    """Half-width per key from (keys…, residual); null with a reason when there are too few.

    The order statistic is the "higher" one: 1-based ``ceil(level * (n - 1)) + 1``.
    A key has folds x horizon residuals, so ranking it in one task is bounded.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    conf = 1 - alpha
    ranked = (
        residuals.where(F.col("residual").isNotNull())
        .withColumn("_a", F.abs("residual"))
        .withColumn("_r", F.row_number().over(w.orderBy("_a")))
        .withColumn("n_calibration", F.count(F.lit(1)).over(w))
    )
    n = F.col("n_calibration")
    level = F.ceil((n + 1) * F.lit(conf)) / n
    pick = F.ceil(level * (n - 1)) + 1
    enough = (n + 1) * F.lit(conf) <= n
    return ranked.groupBy(*keys).agg(
        F.max(F.when(enough & (F.col("_r") == pick), F.col("_a"))).alias("half_width"),
        F.max("n_calibration").alias("n_calibration"),
    )


def apply_interval(forecast: DataFrame, widths: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        forecast.join(widths.select(*keys, "half_width"), list(keys))
        .withColumn("lower", F.col("yhat") - F.col("half_width"))
        .withColumn("upper", F.col("yhat") + F.col("half_width"))
    )


def conformal_coverage(predictions: DataFrame, alpha: float) -> DataFrame:
    """Calibrate on all folds but the last, measure coverage on the last (needs two folds)."""
    last = F.max("fold").over(Window.partitionBy("series_id", "model"))
    first = F.min("fold").over(Window.partitionBy("series_id", "model"))
    tagged = (
        predictions.withColumn("_last", last).withColumn("_first", first)
        .where(F.col("_last") > F.col("_first"))
        .withColumn("residual", F.col("y") - F.col("yhat"))
    )
    widths = conformal_width(tagged.where(F.col("fold") < F.col("_last")), alpha)
    held = tagged.where(F.col("fold") == F.col("_last")).join(widths, ["series_id", "model"])
    return held.groupBy("series_id", "model").agg(
        F.max("half_width").alias("half_width"),
        F.max("n_calibration").alias("n_calibration"),
        F.avg((F.abs("residual") <= F.col("half_width")).cast("double")).alias("coverage"),
    )


# --- anomalies ---------------------------------------------------------------------


def anomaly_flags(
    grid: DataFrame, season: int = fixed.SEASON, window: int = fixed.ANOMALY_WINDOW, z_limit: float = fixed.ANOMALY_Z
) -> DataFrame:
    """Robust z-score of the seasonal difference against its rolling median and MAD."""
    frame = _by_day().rowsBetween(-(window - 1), 0)
    need = window // 2

    def rolling_median(c: str) -> Column:
        return F.when(F.count(c).over(frame) >= need, F.expr(f"percentile({c}, 0.5)").over(frame))

    z = F.try_divide(F.col("_resid") - F.col("_med"), fixed.MAD_TO_SIGMA * F.col("_mad"))
    return (
        grid.withColumn("_resid", F.col("y") - F.lag("y", season).over(_by_day()))
        .withColumn("_med", rolling_median("_resid"))
        .withColumn("_dev", F.abs(F.col("_resid") - F.col("_med")))
        .withColumn("_mad", rolling_median("_dev"))
        .withColumn("zscore", z)
        .withColumn("is_anomaly", F.coalesce(F.abs("zscore") > z_limit, F.lit(False)))
        .drop("_resid", "_med", "_dev", "_mad")
    )


def best_models(fold_metrics: DataFrame, metric: str = "mase") -> DataFrame:
    """The winning model per series."""
    return top_k(
        fold_metrics.groupBy("series_id", "model").agg(F.avg(metric).alias(metric)),
        ["series_id"], [F.asc_nulls_last(metric), F.asc("model")], 1,
    ).drop("rank")
