"""Promotion decisions and the state of the model audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brightloom.functions import fixed
from brightloom.functions.ranking import top_k


def promotion_decisions(
    candidates: DataFrame, incumbents: DataFrame, key: str, margin: float = fixed.PROMOTION_MARGIN,
    min_auc: float = fixed.PROMOTION_MIN_AUC, max_brier: float = fixed.PROMOTION_MAX_BRIER,
) -> DataFrame:
    """Candidates (key, candidate, auc, brier) against the incumbent of the same key, if any.

    Without an incumbent only the margin is waived. Reaching the margin
    exactly promotes. ``reasons`` lists every failed or passed rule.
    """
    prod = incumbents.select(key, F.col("auc").alias("_prod"))
    c = candidates.join(prod, key, "left")
    auc, brier, prod_auc = F.col("auc"), F.coalesce(F.col("brier"), F.lit(0.0)), F.col("_prod")
    required = prod_auc + margin
    low, high = auc < min_auc, brier > max_brier
    behind = prod_auc.isNotNull() & ~(auc >= required)
    beats = prod_auc.isNotNull() & (auc >= required)
    first = prod_auc.isNull() & ~low & ~high
    reasons = F.array(
        F.when(low, F.format_string(fixed.PROMOTION_LOW_AUC.format(min_auc=min_auc), auc)),
        F.when(high, F.format_string(fixed.PROMOTION_HIGH_BRIER.format(max_brier=max_brier), brier)),
        F.when(first, F.lit(fixed.PROMOTION_FIRST)),
        F.when(beats, F.format_string(fixed.PROMOTION_BEATS.format(margin=margin), auc, prod_auc)),
        F.when(
            behind,
            F.format_string(fixed.PROMOTION_BEHIND.format(margin=margin), auc, required, prod_auc),
        ),
    )
    return c.withColumn("promote", ~low & ~high & ~behind).withColumn(
        "reasons", F.filter(reasons, lambda r: r.isNotNull())
    ).drop("_prod")


def registry_state(audit: DataFrame) -> DataFrame:
    """Per model: current production version and rollback target (null when there is none).

    ``audit`` is (model, seq, event, version). Only promote and rollback move
    production. The current version is that of the last such event, the target
    the latest other one, so the two versions with the latest last events decide.
    """
    last = (
        audit.where(F.col("event").isin("promote", "rollback"))
        .groupBy("model", "version").agg(F.max("seq").alias("seq"))
    )
    two = top_k(last, ["model"], [F.desc("seq")], 2)
    return two.groupBy("model").agg(
        F.max(F.when(F.col("rank") == 1, F.col("version"))).alias("current_version"),
        F.max(F.when(F.col("rank") == 2, F.col("version"))).alias("rollback_target"),
    )


def rollback_events(audit: DataFrame, reason: str) -> DataFrame:
    """Audit entries that move each model to its rollback target; a model without one fails the job."""
    state = registry_state(audit)
    target = F.coalesce(
        F.col("rollback_target"),
        F.raise_error(F.concat(F.lit("nothing to roll back to for "), F.col("model").cast("string"))).cast("long"),
    )
    return state.select(
        F.current_timestamp().alias("timestamp"), F.lit("rollback").alias("event"), "model",
        target.alias("version"), F.col("current_version").alias("previous_version"), F.lit(reason).alias("reason"),
    )
