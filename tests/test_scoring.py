import tempfile

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from brightloom.operators import classification as cl, features as ft, models as md


def scored(spark, labels, scores, model="m"):
    rows = [(model, int(y), float(p)) for y, p in zip(labels, scores)]
    return spark.createDataFrame(rows, "model string, label int, score double")


def brute(labels, scores, threshold=0.5):
    y, p = np.asarray(labels), np.asarray(scores)
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = y[hit].sum() / y.sum()
        ap += (recall - last) * y[hit].sum() / hit.sum()
        last = recall
    hit = p >= threshold
    tp = (hit & (y == 1)).sum()
    f1 = 2 * tp / (2 * tp + (hit & (y == 0)).sum() + (~hit & (y == 1)).sum()) if tp else 0.0
    return {"roc_auc": auc, "pr_auc": ap, "f1": f1, "brier": np.mean((p - y) ** 2), "accuracy": np.mean(hit == (y == 1))}


def test_metrics_equal_brute_force_and_evaluator(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    p = np.round(np.clip(0.3 * y + rng.random(400) * 0.7, 0, 1), 2)
    df = scored(spark, y, p)
    r = cl.classification_metrics(df).first()
    for name, value in brute(y, p).items():
        assert r[name] == pytest.approx(value), name
    auc = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(df)
    assert r["roc_auc"] == pytest.approx(auc)
    points = cl.roc_points(df).orderBy(F.desc("threshold")).collect()
    assert points[-1]["fpr"] == points[-1]["tpr"] == 1.0


def test_f1_without_hits_is_zero(spark):
    assert cl.classification_metrics(scored(spark, [1, 0], [0.2, 0.1])).first()["f1"] == 0.0


def test_profit_at_half(spark):
    curve = cl.profit_curve(scored(spark, [1, 1, 0, 0, 1], [0.9, 0.8, 0.6, 0.2, 0.1]), save_rate=0.5)
    assert curve.where(F.round("threshold", 3) == 0.5).first()["profit"] == 450.0
    assert curve.count() == 199


def test_best_threshold(spark):
    df = scored(spark, [0] * 50 + [1] * 25, [0.1] * 50 + [0.9] * 25)
    best = cl.best_threshold(cl.profit_curve(df)).first()
    assert best["profit"] == 4750.0 and best["threshold"] == pytest.approx(0.105)
    f1 = cl.f1_threshold(cl.threshold_counts(df)).first()
    assert f1["f1"] == 1.0 and f1["threshold"] == pytest.approx(0.105)


def test_threshold_is_inclusive_on_the_grid(spark):
    grid = [i * 5 / 1000.0 for i in range(1, 200)]
    counts = cl.threshold_counts(scored(spark, [1] * 199, grid)).orderBy("threshold").collect()
    assert [r["tp"] for r in counts] == list(range(199, 0, -1))


def test_leaderboard_ties_keep_order(spark):
    df = spark.createDataFrame([("b", 0.7), ("a", 0.7), ("c", 0.9)], "model string, roc_auc double")
    rows = cl.leaderboard(df, ["b", "a", "c"]).orderBy("rank").collect()
    assert [r["model"] for r in rows] == ["c", "b", "a"]


def test_attributions(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0), (2, 0.0, 1.0)], "id int, x double, z double")
    coef, means = {"x": 1.0, "z": -2.0}, {"x": 1.0, "z": 0.5}
    rows = {(r["id"], r["sign"], r["rank"]): (r["feature"], r["contribution"]) for r in cl.top_drivers(df, "id", coef, means).collect()}
    assert rows == {
        (1, "positive", 1): ("x", 1.0), (1, "positive", 2): ("z", 1.0), (2, "negative", 1): ("x", -1.0), (2, "negative", 2): ("z", -1.0),
    }
    assert cl.global_importance(df, coef, means, 1).collect()[0].asDict() == {"feature": "x", "mean_abs": 1.0}


def test_engineered_features(spark):
    df = spark.createDataFrame([(6.0, 60.0, 1.0), (6.5, 13.0, 20.0), (0.0, 5.0, 1.0), (49.0, None, 0.0), (None, 1.0, 1.0)], "t double, s double, c double")
    rows = ft.engineer(df, "t", "s", "c").collect()
    assert [r["tenure_bucket"] for r in rows] == ["0-6m", "6-12m", "0-6m", "48m+", None]
    assert [r["charges_per_tenure"] for r in rows] == [10.0, 2.0, 5.0, None, None]
    assert [r["support_calls_per_year"] for r in rows] == [2.0, 24.0, 12.0, 0.0, None]


def test_impute_and_scale(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (9.0, "a"), (None, "b"), (None, None)], "x double, s string")
    fills = ft.fit_impute(df, ["x"], ["s"])
    assert fills == {"x": 2.0, "s": "a"}
    filled = ft.impute(df, fills)
    out = [r["x"] for r in ft.scale(filled, ft.fit_scaler(filled, ["x"])).collect()]
    raw = np.array([1, 2, 9, 2, 2.0])
    assert out == pytest.approx(list((raw - raw.mean()) / raw.std()))


def test_one_hot_unknown_is_all_zero(spark):
    train, new = spark.createDataFrame([("b",), ("a",)], "s string"), spark.createDataFrame([("a",), ("zz",)], "s string")
    index = StringIndexer(inputCols=["s"], outputCols=["i"], handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
    hot = OneHotEncoder(inputCols=["i"], outputCols=["h"], dropLast=True, handleInvalid="keep").fit(index.transform(train))
    got = hot.transform(index.transform(new)).select(vector_to_array("h").alias("h")).collect()
    assert [list(r["h"])[:2] for r in got] == [[1.0, 0.0], [0.0, 0.0]]


def test_folds_balance_classes(spark):
    df = spark.range(100).select("id", (F.col("id") < 30).cast("int").alias("y"))
    sizes = ft.stratified_folds(df, "y", "id", 5).groupBy("fold", "y").count().collect()
    assert sorted((r["y"], r["count"]) for r in sizes) == [(0, 14)] * 5 + [(1, 6)] * 5


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(2)
    x, z = rng.normal(0, 1, 600), rng.normal(0, 1, 600)
    group = rng.choice(["a", "b", "c"], 600)
    y = (x + (group == "a") + rng.normal(0, 0.5, 600) > 0.3).astype(int)
    rows = [(i, float(x[i]) if i % 17 else None, float(z[i]), str(group[i]), int(y[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, x double, z double, g string, label int")
    parts = ft.stratified_holdout(df, "label", "id", 0.25)
    train = parts.where("part = 'train'")
    prepared = md.Prepared(train, ["x", "z"], ["g"])
    return prepared.apply(train), prepared.apply(parts.where("part = 'test'"))


def test_models_beat_chance_and_survive_saving(spark, learnable):
    train, test = learnable
    fitted = md.fit_candidates(train, ["x", "z"], ["g"])
    board = md.compare_candidates(fitted, test, "id").orderBy("rank").collect()
    assert len(board) == 3 and board[2]["roc_auc"] > 0.85 and [r["rank"] for r in board] == [1, 2, 3]
    assert len(fitted["random_forest"].trees.roots) == len(fitted["boosted_trees"].trees.roots) == 300
    for name in ("logistic_regression", "boosted_trees", "random_forest"):
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        md.save_model(fitted[name], path, {"threshold": 0.41, "version": 3})
        model, meta = md.load_model(spark, path)
        assert meta == {"threshold": "0.41", "version": "3"}
        rows = md.batch_scores(model, test, "id", 0.41, 3).collect()
        assert len(rows) == test.count() and all(r["decision"] == (r["probability"] >= 0.41) for r in rows)
        assert sorted(rows) == sorted(md.batch_scores(fitted[name], test, "id", 0.41, 3).collect())
    with pytest.raises(ValueError, match="no candidate named"):
        md.estimator("nope", 10)


def test_training_rows_are_bounded(spark):
    df = spark.range(3000).select(F.array(F.col("id").cast("double")).alias("a"), (F.col("id") % 2).alias("label"), "id")
    df = df.select(array_to_vector("a").alias("features"), "label", "id")
    some, every = md.training_table(df, 500), md.training_table(df)
    assert len(every.y) == 3000 and 350 < len(some.y) < 650 and set(some.x[:, 0]) < set(every.x[:, 0])
    assert (md.training_table(df.repartition(7, "id"), 500).x == some.x).all()
    assert some.weight[some.y == 1].sum() == pytest.approx(len(some.y) / 2)


def test_tuning_is_seeded(learnable):
    train = ft.stratified_folds(learnable[0], "label", "id", 2)
    first = md.tune_boosted_trees(train, ["x", "z"], ["g"], "fold", trials=2).orderBy("rank").collect()
    assert [r["rank"] for r in first] == [1, 2] and first[0]["mean_auc"] >= first[1]["mean_auc"] > 0.7
    again = md.tune_boosted_trees(train.repartition(5), ["x", "z"], ["g"], "fold", trials=2).orderBy("rank").collect()
    assert first == again


def test_candidates_do_the_whole_work():
    forest, boosted, linear = (md.estimator(n, 10) for n in ("random_forest", "boosted_trees", "logistic_regression"))
    assert (forest.getNumTrees(), forest.getMaxDepth(), boosted.getMaxIter(), linear.getMaxIter()) == (300, 30, 300, 2000)
    assert md.estimator("boosted_trees", 10, maxIter=2).getMaxIter() == 2
    assert (md.BOOSTED.rounds, md.BOOSTED.leaves, md.BOOSTED.min_rows, md.BOOSTED.rows, md.BOOSTED.columns) == (300, 31, 20, 0.9, 0.9)
    assert (md.FOREST.rounds, md.FOREST.min_rows) == (300, 5)
    drawn = md.draw_trials(15)
    assert drawn == md.draw_trials(15) and {t.rounds for t in drawn} <= set(range(100, 501, 100))
    assert all(len({getattr(t, k) for t in drawn}) > 1 for k in ("rounds", "rate", "leaves", "min_rows", "l2"))
    many = md.draw_trials(300)
    assert (min(t.leaves for t in many), max(t.leaves for t in many)) == (15, 63)
    assert 1e-3 <= min(t.l2 for t in many) and max(t.l2 for t in many) <= 10 and max(t.rate for t in many) <= 0.2


def test_tuning_searches_the_rounds(learnable):
    train = ft.stratified_folds(learnable[0], "label", "id", 2)
    rows = md.tune_boosted_trees(train, ["x", "z"], ["g"], "fold", trials=3, rounds=(1, 2)).orderBy("trial").collect()
    assert [r["rounds"] for r in rows] == [t.rounds for t in md.draw_trials(3, rounds=(1, 2))]
    assert sorted(r["rank"] for r in rows) == [1, 2, 3]
