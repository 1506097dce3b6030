"""Exact ranking metrics, decision thresholds and attributions for scored rows.

Scored rows are (keys…, label 0/1, score). They collapse to one row per key
and distinct score before anything is ordered; running totals are two-level
(see ``functions.ranking``), so one model with most of the rows is no hot task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightloom.functions import fixed
from brightloom.functions.ranking import running_totals


def score_table(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and distinct score, descending: pos, neg and cumulative tp / fp."""
    counts = scored.groupBy(*keys, (-F.col("score")).alias("_down")).agg(
        F.sum(F.col("label").cast("long")).alias("pos"), F.sum(1 - F.col("label").cast("long")).alias("neg")
    )
    return running_totals(counts, keys, "_down", ["pos", "neg"]).withColumn("score", -F.col("_down")).drop("_down")


def classification_metrics(scored: DataFrame, keys: Sequence[str] = ("model",), threshold: float = 0.5) -> DataFrame:
    """ROC-AUC (ties count half), average precision, F1, Brier score and accuracy per key."""
    keys = list(keys)
    t = score_table(scored, keys)
    pos, neg, score = F.col("pos"), F.col("neg"), F.col("score")
    hit = score >= threshold
    sums = t.groupBy(*keys).agg(
        F.max("all_pos").alias("_p"),
        F.max("all_neg").alias("_n"),
        F.sum(neg * (F.col("cum_pos") - pos + pos * 0.5)).alias("_auc"),
        F.sum(pos * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("_ap"),
        F.sum(F.when(hit, pos).otherwise(0)).alias("_tp"),
        F.sum(F.when(hit, neg).otherwise(0)).alias("_fp"),
        F.sum(pos * (score - 1) * (score - 1) + neg * score * score).alias("_brier"),
    )
    p, n, tp, fp = (F.col(c) for c in ("_p", "_n", "_tp", "_fp"))
    return sums.select(
        *keys,
        F.try_divide("_auc", p * n).alias("roc_auc"),
        F.try_divide("_ap", p).alias("pr_auc"),
        F.coalesce(F.try_divide(2.0 * tp, p + tp + fp), F.lit(0.0)).alias("f1"),
        F.try_divide("_brier", p + n).alias("brier"),
        F.try_divide(tp + n - fp, p + n).alias("accuracy"),
    )


def cv_summary(fold_metrics: DataFrame, names: Sequence[str], key: str = "model") -> DataFrame:
    """Mean and population deviation over folds."""
    return fold_metrics.groupBy(key).agg(
        *[F.avg(m).alias(m) for m in names], *[F.stddev_pop(m).alias(f"{m}_std") for m in names]
    )


def leaderboard(metrics: DataFrame, model_order: Sequence[str], by: str = "roc_auc") -> DataFrame:
    """Rank models by ``by``; equal values keep the order of ``model_order``."""
    position = F.array_position(F.array(*[F.lit(m) for m in model_order]), F.col("model"))
    # One row per model, so ordering them together is bounded by the number of models.
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(by), position)
    return metrics.withColumn("rank", F.row_number().over(w))


def roc_points(scored: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """(fpr, tpr) at every distinct score, from the highest down."""
    t = score_table(scored, keys)
    return t.select(
        *keys, F.col("score").alias("threshold"),
        F.try_divide("cum_neg", "all_neg").alias("fpr"), F.try_divide("cum_pos", "all_pos").alias("tpr"),
    )


# --- thresholds ---------------------------------------------------------------------


def _grid_value(i: Column) -> Column:
    return i * 5 / F.lit(1000.0)


def _grid_index(score: Column) -> Column:
    """How many grid thresholds are <= score, exactly, without a search."""
    guess = F.greatest(F.lit(0), F.least(F.lit(fixed.THRESHOLD_GRID), F.floor(score * 200).cast("int")))
    up = (guess < fixed.THRESHOLD_GRID) & (score >= _grid_value(guess + 1))
    down = (guess > 0) & (score < _grid_value(guess))
    return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)


def threshold_counts(scored: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """tp, fp and fn at each of the 199 thresholds 0.005 … 0.995 (target when score >= threshold)."""
    keys = list(keys)
    buckets = scored.groupBy(*keys, _grid_index(F.col("score")).alias("_i")).agg(
        F.sum(F.col("label").cast("long")).alias("pos"), F.sum(1 - F.col("label").cast("long")).alias("neg")
    )
    totals = buckets.groupBy(*keys).agg(F.sum("pos").alias("_p"))
    grid = totals.select(*keys, "_p", F.explode(F.sequence(F.lit(1), F.lit(fixed.THRESHOLD_GRID))).alias("_i"))
    # At most 200 rows per key from here on.
    onward = Window.partitionBy(*keys).orderBy("_i").rowsBetween(0, Window.unboundedFollowing)
    tp, fp = F.sum(F.coalesce("pos", F.lit(0))).over(onward), F.sum(F.coalesce("neg", F.lit(0))).over(onward)
    return (
        grid.join(buckets, [*keys, "_i"], "left")
        .select(*keys, _grid_value(F.col("_i")).alias("threshold"), tp.alias("tp"), fp.alias("fp"), "_p")
        .withColumn("fn", F.col("_p") - F.col("tp")).drop("_p")
    )


def profit_curve(
    scored: DataFrame, keys: Sequence[str] = ("model",), offer_cost: float = fixed.OFFER_COST,
    loss: float = fixed.CHURN_LOSS, save_rate: float = fixed.SAVE_RATE,
) -> DataFrame:
    gain = save_rate * loss - offer_cost
    return threshold_counts(scored, keys).withColumn(
        "profit", F.col("tp") * F.lit(float(gain)) - F.col("fp") * F.lit(float(offer_cost))
    )


def _first_maximum(curve: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    best = curve.groupBy(*keys).agg(F.max(F.struct(F.col(measure), -F.col("threshold"))).alias("b"))
    return best.select(*keys, (-F.col("b.col2")).alias("threshold"), F.col(f"b.{measure}").alias(measure))


def best_threshold(curve: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Threshold with the highest profit; the lowest threshold wins ties."""
    return _first_maximum(curve, keys, "profit")


def f1_threshold(counts: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return _first_maximum(counts.withColumn("f1", f1), keys, "f1")


# --- additive attributions of a linear model -----------------------------------------


def contributions(coefficients: Mapping[str, float], means: Mapping[str, float]) -> Column:
    """``array<struct<feature, contribution>>`` in log-odds: coef * (x - mean)."""
    return F.array(
        *[
            F.struct(F.lit(f).alias("feature"), (F.lit(float(c)) * (F.col(f) - F.lit(float(means[f])))).alias("contribution"))
            for f, c in coefficients.items()
        ]
    )


def global_importance(df: DataFrame, coefficients: Mapping[str, float], means: Mapping[str, float], n: int = 15) -> DataFrame:
    rows = df.select(F.explode(contributions(coefficients, means)).alias("c")).select("c.*")
    return (
        rows.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
        .orderBy(F.desc("mean_abs"), "feature").limit(n)
    )


def top_drivers(df: DataFrame, row_id: str, coefficients: Mapping[str, float], means: Mapping[str, float], k: int = 3) -> DataFrame:
    """Top ``k`` positive and negative contributions per row, as rows (sign, rank, feature, contribution)."""
    all_of = contributions(coefficients, means)

    def ordered(sign: int) -> Column:
        keep = F.filter(all_of, lambda c: c["contribution"] * sign > 0)
        by_size = F.array_sort(
            F.transform(keep, lambda c: F.struct((c["contribution"] * -sign).alias("o"), c["feature"].alias("feature")))
        )
        return F.slice(by_size, 1, k)

    parts = [
        df.select(row_id, F.lit(name).alias("sign"), F.posexplode(ordered(sign)).alias("p", "d")).select(
            row_id, "sign", (F.col("p") + 1).alias("rank"), F.col("d.feature").alias("feature"),
            (F.col("d.o") * -sign).alias("contribution"),
        )
        for name, sign in (("positive", 1), ("negative", -1))
    ]
    return parts[0].unionByName(parts[1])
