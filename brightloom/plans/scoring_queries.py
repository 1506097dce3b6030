"""Registered feature, metric, threshold and model queries with their oracles."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from brightloom.functions import fixed
from brightloom.operators import classification as cl, features as ft, models as md, quality as ql
from brightloom.plans.bindings import (
    CATEGORICAL, CUSTOMERS_SQL, NUMERIC, SCORE_MODELS, SCORED_SQL, customer_features, scored_customers,
)
from brightloom.session import materialised
from brightloom.sources.tables import table

METRICS = ["roc_auc", "pr_auc", "f1", "brier", "accuracy"]
COEFFICIENTS = {"n_orders": -0.3, "tenure_months": -0.02, "n_pending": 0.1, "balance": 0.0001}
MEANS = {"n_orders": 10.0, "tenure_months": 70.0, "n_pending": 3.0, "balance": 5000.0}
LINE_RULES = (
    ql.ColumnRule("l_orderkey", "integer", min_value=0),
    ql.ColumnRule("l_linenumber", "integer", min_value=1, max_value=7),
    ql.ColumnRule("l_quantity", "numeric", min_value=1, max_value=40),
    ql.ColumnRule("l_discount", "numeric", min_value=0, max_value=0.1),
    ql.ColumnRule("l_tax", "numeric", min_value=0, max_value=0.05),
    ql.ColumnRule("l_returnflag", "categorical", allowed_values=("A", "R")),
    ql.ColumnRule("l_linestatus", "categorical", allowed_values=("F", "O")),
)


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def customer_engineered(spark, sf):
    out = ft.engineer(customer_features(spark, sf), "tenure_months", "spend", "n_pending")
    return _round(
        out.select("customer_id", "tenure_bucket", "charges_per_tenure", "support_calls_per_year"),
        "charges_per_tenure", "support_calls_per_year",
    )


def impute_stats(spark, sf):
    return _round(ft.impute_table(customer_features(spark, sf), NUMERIC, CATEGORICAL), "median")


def standardized(spark, sf):
    c = customer_features(spark, sf)
    filled = ft.impute(c, ft.fit_impute(c, ["balance", "tenure_months"], ["segment"]))
    out = ft.scale(filled, ft.fit_scaler(filled, ["balance", "tenure_months"]))
    return _round(out.select("customer_id", "segment", "balance", "tenure_months"), "balance", "tenure_months")


def stratified_holdout(spark, sf):
    c = customer_features(spark, sf).select("customer_id", "label")
    return ft.stratified_holdout(c, "label", "customer_id", 0.2).select("customer_id", "label", "part")


def one_hot(spark, sf):
    """The set place of each customer's one-hot segment."""
    c = customer_features(spark, sf).select("customer_id", "segment")
    hot = Pipeline(stages=md.encoder_stages([], ["segment"])).fit(c).transform(c)
    placed = hot.select("customer_id", F.posexplode(vector_to_array("segment_hot")).alias("place", "value"))
    return placed.where("value > 0")


def _scores(spark, sf):
    """The scored rows, written once: running totals read them several times."""
    return materialised(scored_customers(spark, sf), "scores")


def classification_metrics(spark, sf):
    return _round(cl.classification_metrics(_scores(spark, sf)), *METRICS)


def _cv(spark, sf):
    folds = ft.stratified_folds(
        customer_features(spark, sf).select("customer_id", "label"), "label", "customer_id", 5
    ).select("customer_id", "fold")
    by_fold = cl.classification_metrics(_scores(spark, sf).join(folds, "customer_id"), ["model", "fold"])
    return cl.cv_summary(by_fold, METRICS)


def cv_metrics(spark, sf):
    return _round(_cv(spark, sf), *METRICS, *[f"{m}_std" for m in METRICS])


def model_leaderboard(spark, sf):
    ranked = cl.leaderboard(cl.classification_metrics(_scores(spark, sf)), SCORE_MODELS)
    return _round(ranked.select("model", "rank", "roc_auc"), "roc_auc")


def roc_points(spark, sf):
    return _round(cl.roc_points(_scores(spark, sf)), "fpr", "tpr")


def profit_curve(spark, sf):
    return _round(cl.profit_curve(scored_customers(spark, sf)), "threshold", "profit")


def best_threshold(spark, sf):
    return _round(cl.best_threshold(cl.profit_curve(scored_customers(spark, sf))), "threshold", "profit")


def f1_threshold(spark, sf):
    return _round(cl.f1_threshold(cl.threshold_counts(scored_customers(spark, sf))), "threshold", "f1")


def _filled(spark, sf):
    return customer_features(spark, sf).withColumns({c: F.coalesce(c, F.lit(m)) for c, m in MEANS.items()})


def linear_attributions(spark, sf):
    return _round(cl.global_importance(_filled(spark, sf), COEFFICIENTS, MEANS), "mean_abs")


def top_drivers(spark, sf):
    return _round(cl.top_drivers(_filled(spark, sf), "customer_id", COEFFICIENTS, MEANS, 3), "contribution")


def quarantine(spark, sf):
    li = table(spark, sf, "lineitem").select(*[r.name for r in LINE_RULES])
    rejected = ql.quarantine(li, LINE_RULES)[1]
    return rejected.select("l_orderkey", "l_linenumber", F.array_join("reasons", "; ").alias("reasons"))


def _prepared(spark, sf):
    # Every fit reads these rows many times, so the joined features are written once.
    c = materialised(ft.stratified_holdout(customer_features(spark, sf), "label", "customer_id", 0.2), "training-rows")
    train = c.where(F.col("part") == "train")
    prepared = md.Prepared(train, NUMERIC, CATEGORICAL)
    return prepared.apply(train), prepared.apply(c.where(F.col("part") == "test"))


def train_candidates(spark, sf):
    train, test = _prepared(spark, sf)
    return md.compare_candidates(md.fit_candidates(train, NUMERIC, CATEGORICAL), test, "customer_id")


def tuned_model(spark, sf):
    train, _ = _prepared(spark, sf)
    folded = ft.stratified_folds(train, "label", "customer_id", 3)
    return md.tune_boosted_trees(folded, NUMERIC, CATEGORICAL, "fold")


def batch_scores(spark, sf):
    train, test = _prepared(spark, sf)
    model = md.fit_candidates(train, NUMERIC, CATEGORICAL, ["logistic_regression"])["logistic_regression"]
    return md.batch_scores(model, test, "customer_id", 0.41, 1)


QUERIES = {
    "customer_features": customer_engineered,
    **{
        f.__name__: f
        for f in (
            impute_stats, standardized, stratified_holdout, one_hot, classification_metrics, cv_metrics, model_leaderboard,
            roc_points, profit_curve, best_threshold, f1_threshold, linear_attributions, top_drivers, quarantine,
            train_candidates, tuned_model, batch_scores,
        )
    },
}

# --- oracles ---------------------------------------------------------------------------


def _metrics_sql(source: str, keys: str) -> str:
    return f"""
src AS ({source}),
sc AS (SELECT {keys}, score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM src GROUP BY {keys}, score),
cu AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY {keys}) AS p,
  sum(neg) OVER (PARTITION BY {keys}) AS n FROM sc WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC)),
met AS (SELECT {keys}, sum(neg * (cp - pos / 2)) / nullif(any_value(p * n), 0) AS roc_auc,
  sum(pos * cp / (cp + cn)) / nullif(any_value(p), 0) AS pr_auc,
  coalesce(2 * sum(pos) FILTER (score >= 0.5) / (any_value(p) + sum(pos + neg) FILTER (score >= 0.5)), 0) AS f1,
  sum(pos * (1 - score) * (1 - score) + neg * score * score) / any_value(p + n) AS brier,
  (coalesce(sum(pos) FILTER (score >= 0.5), 0) + coalesce(sum(neg) FILTER (score < 0.5), 0)) / any_value(p + n) AS accuracy
  FROM cu GROUP BY {keys})"""


_M = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)
_GRID = f"""
g AS (SELECT i * 5 / 1000.0::DOUBLE AS t FROM range(1, 200) r(i)), s AS ({SCORED_SQL}),
th AS (SELECT model, t, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label = 0) AS fp,
  count(*) FILTER (score < t AND label = 1) AS fn FROM s, g GROUP BY 1, 2),
pr AS (SELECT *, tp * ({fixed.SAVE_RATE} * {fixed.CHURN_LOSS} - {fixed.OFFER_COST})::DOUBLE - fp * {fixed.OFFER_COST}::DOUBLE AS profit,
  coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM th)"""
_FILLED = (
    "SELECT customer_id, " + ", ".join(f"coalesce({c}, {m}) AS {c}" for c, m in MEANS.items()) + f" FROM ({CUSTOMERS_SQL})"
)
_CONTRIB = " UNION ALL ".join(
    f"SELECT customer_id, '{f}' AS feature, {c}::DOUBLE * ({f} - {MEANS[f]}::DOUBLE) AS contribution FROM filled"
    for f, c in COEFFICIENTS.items()
)


def _reason_sql(r: ql.ColumnRule) -> list[str]:
    out = [f"CASE WHEN {r.name} IS NULL THEN '{r.name} missing' END"]
    if r.min_value is not None or r.max_value is not None:
        low = "-inf" if r.min_value is None else str(float(r.min_value))
        high = "inf" if r.max_value is None else str(float(r.max_value))
        tests = [f"{r.name} < {r.min_value}" if r.min_value is not None else None, f"{r.name} > {r.max_value}::DOUBLE" if r.max_value is not None else None]
        cond = " OR ".join(t for t in tests if t)
        out.append(f"CASE WHEN {cond} THEN '{r.name} outside [{low}, {high}]' END")
    if r.allowed_values:
        out.append(f"CASE WHEN {r.name} NOT IN {r.allowed_values} THEN '{r.name} unexpected' END")
    return out


_REASONS = "list_filter([" + ", ".join(x for r in LINE_RULES for x in _reason_sql(r)) + "], lambda x: x IS NOT NULL)"

ORACLES = {
    "one_hot": f"""SELECT customer_id, (dense_rank() OVER (ORDER BY segment) - 1)::INT AS place, 1.0::DOUBLE AS value FROM ({CUSTOMERS_SQL})""",
    "customer_features": f"""WITH c AS ({CUSTOMERS_SQL})
SELECT customer_id, CASE WHEN tenure_months <= 6 THEN '0-6m' WHEN tenure_months <= 12 THEN '6-12m'
  WHEN tenure_months <= 24 THEN '12-24m' WHEN tenure_months <= 48 THEN '24-48m' WHEN tenure_months IS NOT NULL THEN '48m+' END AS tenure_bucket,
  round(spend / CASE WHEN tenure_months < 1 THEN 1 ELSE tenure_months END, 6) AS charges_per_tenure,
  round(CASE WHEN 12 * n_pending / CASE WHEN tenure_months < 1 THEN 1 ELSE tenure_months END > 24 THEN 24
    ELSE 12 * n_pending / CASE WHEN tenure_months < 1 THEN 1 ELSE tenure_months END END, 6) AS support_calls_per_year FROM c""",
    "impute_stats": f"WITH c AS ({CUSTOMERS_SQL}) "
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(quantile_cont({c}, 0.5), 6) AS median, NULL::VARCHAR AS most_frequent FROM c" for c in NUMERIC)
    + "".join(
        f" UNION ALL (SELECT '{c}', NULL, {c} FROM c GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in CATEGORICAL
    ),
    "standardized": f"""WITH c AS ({CUSTOMERS_SQL}),
f AS (SELECT customer_id, coalesce(segment, (SELECT segment FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS segment,
  coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM c)) AS balance,
  coalesce(tenure_months, (SELECT quantile_cont(tenure_months, 0.5) FROM c)) AS tenure_months FROM c)
SELECT customer_id, segment, round((balance - avg(balance) OVER ()) / stddev_pop(balance) OVER (), 6) AS balance,
  round((tenure_months - avg(tenure_months) OVER ()) / stddev_pop(tenure_months) OVER (), 6) AS tenure_months FROM f""",
    "stratified_holdout": f"""WITH c AS ({CUSTOMERS_SQL}), r AS (SELECT customer_id, label,
  row_number() OVER (PARTITION BY label ORDER BY md5('42:' || customer_id::VARCHAR), customer_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM c)
SELECT customer_id, label, CASE WHEN rn <= round_even(n * 0.2, 0) THEN 'test' ELSE 'train' END AS part FROM r""",
    "classification_metrics": f"WITH {_metrics_sql(SCORED_SQL, 'model')} SELECT model, {_M} FROM met",
    "cv_metrics": f"""WITH c AS ({CUSTOMERS_SQL}), fo AS (SELECT customer_id AS cid, (row_number() OVER (PARTITION BY label
  ORDER BY md5('42:' || customer_id::VARCHAR), customer_id) - 1) % 5 AS fold FROM c),
{_metrics_sql(f"SELECT s.*, fold FROM ({SCORED_SQL}) s JOIN fo ON cid = customer_id", 'model, fold')}
SELECT model, """ + ", ".join(f"round(avg({m}), 6) AS {m}, round(stddev_pop({m}), 6) AS {m}_std" for m in METRICS) + " FROM met GROUP BY 1",
    "model_leaderboard": f"""WITH {_metrics_sql(SCORED_SQL, 'model')} SELECT model,
  row_number() OVER (ORDER BY met.roc_auc DESC, list_position({SCORE_MODELS}, model))::INT AS rank, round(roc_auc, 6) AS roc_auc FROM met""",
    "roc_points": f"""WITH {_metrics_sql(SCORED_SQL, 'model')} SELECT model, score AS threshold, round(cn / n, 6) AS fpr, round(cp / p, 6) AS tpr FROM cu""",
    "profit_curve": f"WITH {_GRID} SELECT model, round(t, 6) AS threshold, tp, fp, fn, round(profit, 6) AS profit FROM pr",
    "best_threshold": f"""WITH {_GRID} SELECT model, round(arg_min(t, (-profit, t)), 6) AS threshold, round(max(profit), 6) AS profit FROM pr GROUP BY 1""",
    "f1_threshold": f"""WITH {_GRID} SELECT model, round(arg_min(t, (-f1, t)), 6) AS threshold, round(max(f1), 6) AS f1 FROM pr GROUP BY 1""",
    "linear_attributions": f"WITH filled AS ({_FILLED}), k AS ({_CONTRIB}) SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs FROM k GROUP BY 1",
    "top_drivers": f"""WITH filled AS ({_FILLED}), k AS ({_CONTRIB}),
r AS (SELECT *, CASE WHEN contribution > 0 THEN 'positive' ELSE 'negative' END AS sign FROM k WHERE contribution <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY customer_id, sign ORDER BY abs(contribution) DESC, feature)::INT AS rank FROM r)
SELECT customer_id, sign, rank, feature, round(contribution, 6) AS contribution FROM o WHERE rank <= 3""",
    "quarantine": f"""WITH f AS (SELECT l_orderkey, l_linenumber, {_REASONS} AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, array_to_string(r, '; ') AS reasons FROM f WHERE len(r) > 0""",
}
