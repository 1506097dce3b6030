"""Drift of incoming windows against one reference: PSI, KS, severity, report.

Features are unpivoted, so all of them go through one job. Numbers are never
shuffled as values: bin edges and distances come from radix selection, and the
rows of a window are counted into the reference's bins on the map side. A
column ``n`` says how often a row counts, so value counts do as well as rows.
Names of features bound the broadcast tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from brightloom.functions import fixed, radix
from brightloom.session import materialised


def feature_values(df: DataFrame, columns: Sequence[str], window: str | None = None) -> DataFrame:
    """(feature[, window], value, n = 1): the numbers as they are, null ones too."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    keys = [F.col(window).alias("window")] if window else []
    picked = df.select(*keys, F.explode(F.array(*cells)).alias("c"))
    return picked.select("c.feature", *(["window"] if window else []), "c.value", F.lit(1).cast("long").alias("n"))


def feature_counts(df: DataFrame, columns: Sequence[str], kind: str, window: str | None = None) -> DataFrame:
    """(feature[, window], value, n) including null values."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value")) for c in columns]
    keys = ["window"] if window else []
    picked = df.select(*([F.col(window).alias("window")] if window else []), F.explode(F.array(*cells)).alias("c"))
    return picked.select("c.feature", *keys, "c.value").groupBy("feature", *keys, "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def bin_edges(ref: DataFrame, bins: int = fixed.PSI_BINS) -> DataFrame:
    """Distinct inner quantile edges of the reference per feature."""
    inner = [i * (1.0 / bins) for i in range(1, bins)]
    found = radix.quantiles(ref, ["feature"], "value", inner, "n")
    return found.select("feature", F.array_distinct("quantiles").alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """Index of the bin ``[edge, next edge)``; the outer bins are open-ended."""
    return F.size(F.filter(edges, lambda e: e <= value))


def _floored(n: Column, total: Column) -> Column:
    return F.greatest(F.coalesce(F.try_divide(n, total), F.lit(0.0)), F.lit(fixed.PSI_FLOOR))


def _packed_bins(placed: DataFrame, *keys: str) -> DataFrame:
    """Bin counts of a key as one map (a feature has at most ``bins`` bins) with their total."""
    return placed.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"), F.sum("n").alias("total")
    )


def place(counts: DataFrame, edges: DataFrame, *keys: str) -> DataFrame:
    """(feature, keys…, bin, n); ``edges`` has one row per feature."""
    cut = counts.where(F.col("value").isNotNull()).join(F.broadcast(edges), "feature")
    return cut.groupBy("feature", *keys, bin_of(F.col("value"), F.col("edges")).alias("bin")).agg(F.sum("n").alias("n"))


def reference_profile(ref: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, edges, shares): floored reference share of every bin, empty ones included."""
    share = lambda b: _floored(F.try_element_at("by_bin", b), F.col("total"))
    return _packed_bins(place(ref, edges), "feature").join(F.broadcast(edges), "feature").select(
        "feature", "edges", F.transform(F.sequence(F.lit(0), F.size("edges")), share).alias("shares")
    )


def psi_of_bins(bins: DataFrame, profile: DataFrame, *keys: str) -> DataFrame:
    """(feature, keys…, psi) of bin counts against a profile; every bin of the profile counts."""
    share = lambda b: _floored(F.try_element_at("by_bin", b), F.col("total"))
    terms = F.transform("shares", lambda s, b: (share(b) - s) * F.log(share(b) / s))
    joined = _packed_bins(bins, "feature", *keys).join(F.broadcast(profile), "feature")
    return joined.select("feature", *keys, F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x).alias("psi"))


def psi_numeric(ref: DataFrame, cur: DataFrame, bins: int = fixed.PSI_BINS) -> DataFrame:
    """(feature, window, psi) over quantile bins of the reference."""
    edges = materialised(bin_edges(ref, bins), "bin-edges")
    return psi_of_bins(place(cur, edges, "window"), reference_profile(ref, edges), "window")


def _psi_sum(full: DataFrame) -> DataFrame:
    ref = _floored(F.col("ref_n"), F.col("ref_total"))
    cur = _floored(F.col("cur_n"), F.col("cur_total"))
    return full.groupBy("feature", "window").agg(F.sum((cur - ref) * F.log(cur / ref)).alias("psi"))


def psi_categorical(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """PSI over the union of categories; nulls count in the denominators but form no bin."""
    ref_totals = ref.groupBy("feature").agg(F.sum("n").alias("ref_total"))
    cur_totals = cur.groupBy("feature", "window").agg(F.sum("n").alias("cur_total"))
    known = F.col("value").isNotNull()
    ref_n, cur_n = ref.where(known).withColumnRenamed("n", "ref_n"), cur.where(known).withColumnRenamed("n", "cur_n")
    pairs = (
        cur_totals.select("feature", "window").join(ref_n.select("feature", "value"), "feature")
        .unionByName(cur_n.select("feature", "window", "value")).distinct()
    )
    full = (
        pairs.join(ref_n, ["feature", "value"], "left").join(cur_n, ["feature", "window", "value"], "left")
        .join(ref_totals, "feature").join(cur_totals, ["feature", "window"])
    )
    return _psi_sum(full)


def ks_statistic(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """(feature, window, ks_statistic, n_reference, n_current), exact."""
    return radix.ks_distances(ref, cur, "n")


def ks_critical(n_ref: Column, n_cur: Column, alpha: float = fixed.KS_ALPHA) -> Column:
    c = math.sqrt(-0.5 * math.log(alpha / 2.0))
    return F.lit(c) * F.sqrt((n_ref + n_cur) / (n_ref.cast("double") * n_cur))


def severity(psi: Column, ks_drifted: Column | None = None, warn: float = fixed.PSI_WARN, alert: float = fixed.PSI_ALERT) -> Column:
    out = F.when(psi >= alert, "alert").when(psi >= warn, "warn")
    if ks_drifted is not None:
        out = out.when(ks_drifted, "warn")
    return out.otherwise("none")


def drift_report(
    reference: DataFrame, current: DataFrame, window: str, numeric: Sequence[str], categorical: Sequence[str],
    alpha: float = fixed.KS_ALPHA, retrain_alerts: int = fixed.RETRAIN_ALERTS,
) -> DataFrame:
    """One row per (window, feature). Severity uses the unrounded values; ``retrain`` is per window.

    A feature without any value on one side has null PSI and severity
    ``missing``, which counts as an alert: a feed that broke must not look calm.

    Numeric columns are read in several narrow passes that shuffle only counts;
    categories are counted once.
    """
    ref_num, cur_num = feature_values(reference, numeric), feature_values(current, numeric, window)
    edges = materialised(bin_edges(ref_num), "bin-edges")
    psi = psi_of_bins(place(cur_num, edges, "window"), reference_profile(ref_num, edges), "window")
    ref_cat = materialised(feature_counts(reference, categorical, "string"), "reference-counts")
    cur_cat = materialised(feature_counts(current, categorical, "string", window), "window-counts")
    ks = ks_statistic(ref_num, cur_num).withColumn("ks_critical", ks_critical(F.col("n_reference"), F.col("n_current"), alpha))
    num = psi.join(ks, ["feature", "window"]).select(
        "window", "feature", "psi", "ks_statistic", "ks_critical",
        severity(F.col("psi"), F.col("ks_statistic") > F.col("ks_critical")).alias("severity"),
    )
    none = F.lit(None).cast("double")
    cat = psi_categorical(ref_cat, cur_cat).select(
        "window", "feature", "psi", none.alias("ks_statistic"), none.alias("ks_critical"),
        severity(F.col("psi")).alias("severity"),
    )
    every = current.select(F.col(window).alias("window")).distinct()
    every = every.withColumn("feature", F.explode(F.array(*map(F.lit, [*numeric, *categorical]))))
    rows = every.join(num.unionByName(cat), ["window", "feature"], "left")
    rows = rows.withColumn("severity", F.when(F.col("psi").isNull(), "missing").otherwise(F.col("severity")))
    alerts = rows.groupBy("window").agg(F.count_if(F.col("severity").isin("alert", "missing")).alias("alerts"))
    return rows.join(alerts, "window").select(
        "window", "feature", F.round("psi", 6).alias("psi"), F.round("ks_statistic", 6).alias("ks_statistic"),
        F.round("ks_critical", 6).alias("ks_critical"), "severity", "alerts",
        (F.col("alerts") >= retrain_alerts).alias("retrain"),
    )
