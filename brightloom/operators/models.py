"""Candidate classifiers: fit, compare, tune, score, persist.

The logistic model is ``pyspark.ml``'s. Forest and boosted trees grow by leaves on
a bounded training table (``functions.trees``), a task per fit; ``estimator`` also
has ``pyspark.ml``'s own trees for those who want to train on every row.
"""

from __future__ import annotations

import pickle
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from brightloom.functions.trees import Growth, Trees, auc, boost, forest_trees, joined_forest
from brightloom.operators import classification as cl, features as ft

CANDIDATES = ("logistic_regression", "random_forest", "boosted_trees")
#: The deepest tree that ``pyspark.ml`` builds; its forest's trees are not limited otherwise.
MAX_DEPTH = 30
#: Boosting rounds that tuning chooses from.
ROUNDS = (100, 200, 300, 400, 500)


def estimator(name: str, n_rows: int, seed: int = 42, **params):
    """A ``pyspark.ml`` classifier over (features, label, weight); ``params`` replace its settings.

    Its trees grow by levels: 31 leaves are depth 5, and forest trees end at depth 30.
    """
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    if name == "logistic_regression":
        c = params.pop("C", 1.0)
        settings = {"maxIter": 2000, "regParam": 1.0 / (c * max(n_rows, 1)), **params}
        return LogisticRegression(**common, **settings)
    if name == "random_forest":
        settings = {"numTrees": 300, "maxDepth": MAX_DEPTH, "minInstancesPerNode": 5, "seed": seed, **params}
        return RandomForestClassifier(**common, **settings)
    if name == "boosted_trees":
        settings = {
            "maxIter": 300, "maxDepth": 5, "stepSize": 0.05, "minInstancesPerNode": 20, "subsamplingRate": 0.9,
            "featureSubsetStrategy": "0.9", "seed": seed, **params,
        }
        return GBTClassifier(**common, **settings)
    raise ValueError(f"no candidate named {name!r} among {list(CANDIDATES)}")


def encoder_stages(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """One-hot (sorted categories, unknown = all zeros) plus the assembled vector."""
    indexed, hot = [f"{c}_ix" for c in categorical], [f"{c}_hot" for c in categorical]
    return [
        StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True, handleInvalid="keep"),
        VectorAssembler(inputCols=[*numeric, *hot], outputCol="features"),
    ]


class Prepared:
    """Imputation and scaling fitted on the training rows only."""

    def __init__(self, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> None:
        self.numeric, self.categorical = list(numeric), list(categorical)
        self.fills = ft.fit_impute(train, numeric, categorical)
        self.scales = ft.fit_scaler(ft.impute(train, self.fills), numeric)

    def apply(self, df: DataFrame) -> DataFrame:
        return ft.scale(ft.impute(df, self.fills), self.scales)


def with_balanced_weights(df: DataFrame, label: str = "label") -> tuple[DataFrame, int]:
    """Adds ``weight`` = n / (2 * class size); returns the row count too."""
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(sizes.values())
    weight = F.lit(1.0)
    for value, size in sizes.items():
        weight = F.when(F.col(label) == value, F.lit(n / (2.0 * size))).otherwise(weight)
    return df.withColumn("weight", weight), n


def scored_rows(model: PipelineModel | TreeModel, df: DataFrame, row_id: str, name: str) -> DataFrame:
    return model.transform(df).select(F.lit(name).alias("model"), row_id, "label", _positive(model).alias("score"))


# --- trees on a bounded training table ------------------------------------------------

#: Labelled rows that the tree models learn from at most; which ones, the hash of the row decides. All rows are scored.
TRAINING_ROWS = 50_000
#: Settings of the candidates that are fitted here.
BOOSTED = Growth(rounds=300, rate=0.05, leaves=31, min_rows=20, rows=0.9, columns=0.9, seed=42)
FOREST = Growth(rounds=300, leaves=1 << 31, min_rows=5, seed=42)
#: Trees of a forest that one task grows.
TREES_PER_TASK = 10


@dataclass
class TrainingTable:
    """Encoded training rows as arrays; small enough for one machine by ``TRAINING_ROWS``."""

    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray

    @property
    def weight(self) -> np.ndarray:
        return self.balanced(np.arange(len(self.y)))

    def balanced(self, rows: np.ndarray) -> np.ndarray:
        """n / (2 * class size) among ``rows``."""
        return (len(rows) / (2.0 * np.maximum(np.bincount(self.y[rows], minlength=2), 1)))[self.y[rows]]


def training_table(encoded: DataFrame, limit: int = TRAINING_ROWS, fold_col: str | None = None) -> TrainingTable:
    """``encoded(features, label)`` as arrays: all rows, or about ``limit`` of them by the hash of their values."""
    n = encoded.count()
    if n > limit:
        encoded = encoded.where(F.pmod(F.xxhash64(*encoded.columns), F.lit(1 << 32)) < int(limit / n * (1 << 32)))
    fold = F.col(fold_col) if fold_col else F.lit(0)
    held = encoded.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"), fold.cast("int").alias("f")).toArrow()
    x = held["x"].combine_chunks()
    width = len(x[0]) if len(x) else 0
    table = TrainingTable(x.flatten().to_numpy().reshape(len(x), width), held["y"].to_numpy(), held["f"].to_numpy())
    order = np.lexsort((*table.x.T, table.y, table.fold))  # the same models whatever the order rows arrive in
    return TrainingTable(table.x[order], table.y[order], table.fold[order])


def _tasks(spark: SparkSession, n: int, work: Callable[[int], Iterator[tuple]], schema: str) -> DataFrame:
    """Run ``work(i)`` for i below ``n``, each in a Spark task of its own; its tuples are the rows."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame["id"]:
                yield pd.DataFrame(list(work(int(i))), columns=names)

    return spark.range(0, n, 1, n).mapInPandas(run, schema)


def fit_trees(spark: SparkSession, table: TrainingTable, name: str, growth: Growth) -> Trees:
    """Boosted trees in one task, a forest in many; the model comes back as arrays bounded by the training table."""
    shared = spark.sparkContext.broadcast(table)  # TRAINING_ROWS rows at most

    def boosted(_: int) -> Iterator[tuple]:
        t = shared.value
        yield 0, pickle.dumps(boost(t.x, t.y, t.weight, growth))

    def grown(task: int) -> Iterator[tuple]:
        t, numbers = shared.value, range(task * TREES_PER_TASK, min((task + 1) * TREES_PER_TASK, growth.rounds))
        for number, tree in zip(numbers, forest_trees(t.x, t.y, t.weight, growth, iter(numbers)), strict=True):
            yield number, pickle.dumps(tree)

    if name == "boosted_trees":
        return pickle.loads(_tasks(spark, 1, boosted, "number int, tree binary").first()["tree"])
    rows = _tasks(spark, -(-growth.rounds // TREES_PER_TASK), grown, "number int, tree binary").orderBy("number").collect()
    return joined_forest([pickle.loads(r["tree"]) for r in rows], table.x)


class TreeModel:
    """Encoder and fitted trees; ``transform`` adds ``probability`` as an array (class 0, class 1) by batches."""

    def __init__(self, encoder: PipelineModel, trees: Trees):
        self.encoder, self.trees = encoder, trees

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.trees)  # bounded by the training table

        @F.pandas_udf("double")
        def positive(x: pd.Series) -> pd.Series:
            return pd.Series(shared.value.predict(np.stack(x.to_list())) if len(x) else [], dtype=float)

        encoded = self.encoder.transform(df).withColumn("_p", positive(vector_to_array("features")))
        return encoded.withColumn("probability", F.array(1 - F.col("_p"), F.col("_p"))).drop("_p")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.encoder.write().overwrite().save(f"{path}/encoder")
        rows = [(name, a.dtype.str, a.tobytes()) for name, a in self.trees.to_arrays().items()] + [("kind", "", self.trees.kind.encode())]
        spark.createDataFrame(rows, "name string, type string, data binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        rows = {r["name"]: r for r in spark.read.parquet(f"{path}/trees").collect()}
        kind = bytes(rows.pop("kind")["data"]).decode()
        arrays = {name: np.frombuffer(bytes(r["data"]), r["type"]) for name, r in rows.items()}
        return cls(PipelineModel.load(f"{path}/encoder"), Trees.from_arrays(kind, **arrays))


def _positive(model: PipelineModel | TreeModel) -> Column:
    return F.col("probability")[1] if isinstance(model, TreeModel) else vector_to_array("probability")[1]


def fit_candidates(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], names: Sequence[str] = CANDIDATES, seed: int = 42,
    rows: int = TRAINING_ROWS,
) -> dict[str, PipelineModel | TreeModel]:
    """Fit every candidate on prepared training rows (already imputed and scaled), classes weighted alike.

    The logistic model is fitted by ``pyspark.ml`` on all rows; the trees learn from at most about ``rows`` of them.
    """
    weighted, n = with_balanced_weights(train)
    encoder = Pipeline(stages=encoder_stages(numeric, categorical)).fit(weighted)
    encoded = encoder.transform(weighted).select("features", "label", "weight").persist()
    try:
        out: dict[str, PipelineModel | TreeModel] = {}
        table = training_table(encoded, rows) if set(names) - {"logistic_regression"} else None
        for name in names:
            if name in ("random_forest", "boosted_trees"):
                growth = replace(FOREST if name == "random_forest" else BOOSTED, seed=seed)
                out[name] = TreeModel(encoder, fit_trees(train.sparkSession, table, name, growth))
            else:
                out[name] = PipelineModel(stages=[*encoder.stages, estimator(name, n, seed).fit(encoded)])
        return out
    finally:
        encoded.unpersist()


def compare_candidates(fitted: dict[str, PipelineModel | TreeModel], test: DataFrame, row_id: str) -> DataFrame:
    """Holdout metrics per candidate with rank; the best has rank 1."""
    parts = [scored_rows(m, test, row_id, name) for name, m in fitted.items()]
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return cl.leaderboard(cl.classification_metrics(scored), list(fitted))


def draw_trials(trials: int, seed: int = 42, rounds: Sequence[int] = ROUNDS) -> list[Growth]:
    """Seeded settings of boosted trees: rounds, learning rate, leaves, rows per leaf and L2 penalty on leaves."""
    rng = random.Random(seed)
    return [
        replace(
            BOOSTED, rounds=rng.choice(list(rounds)), rate=round(0.02 * 10 ** rng.random(), 4), leaves=rng.randint(15, 63),
            min_rows=rng.randint(10, 60), l2=10 ** rng.uniform(-3, 1), seed=seed,
        )
        for _ in range(trials)
    ]


def tune_boosted_trees(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], fold_col: str, trials: int = 15, seed: int = 42,
    rounds: Sequence[int] = ROUNDS, rows: int = TRAINING_ROWS,
) -> DataFrame:
    """Seeded random search maximising the mean CV AUC: one row per trial with its rank.

    Every (trial, fold) is a task of its own over at most about ``rows`` training rows.
    """
    drawn, spark = draw_trials(trials, seed, rounds), train.sparkSession
    encoded = Pipeline(stages=encoder_stages(numeric, categorical)).fit(train).transform(train)
    table = training_table(encoded.select("features", "label", fold_col), rows, fold_col)
    n_folds = int(table.fold.max()) + 1 if len(table.fold) else 1
    shared = spark.sparkContext.broadcast(table)  # TRAINING_ROWS rows at most

    def fitted(task: int) -> Iterator[tuple]:
        t, (trial, fold) = shared.value, divmod(task, n_folds)
        fit, held = np.flatnonzero(t.fold != fold), np.flatnonzero(t.fold == fold)
        model = boost(t.x[fit], t.y[fit], t.balanced(fit), drawn[trial])
        yield trial, fold, auc(model.predict(t.x[held]), t.y[held])

    scores = _tasks(spark, trials * n_folds, fitted, "trial int, fold int, auc double")
    mean = scores.groupBy("trial").agg(F.avg("auc").alias("mean_auc"))
    settings = spark.createDataFrame(
        [(i, g.rounds, g.leaves, g.rate, g.min_rows, g.l2) for i, g in enumerate(drawn)],
        "trial int, rounds int, leaves int, step_size double, min_rows int, l2 double",
    )
    first = Window.orderBy(F.desc("mean_auc"), "trial")  # one row per trial
    return settings.join(mean, "trial").withColumn("rank", F.row_number().over(first))


def batch_scores(model: PipelineModel | TreeModel, df: DataFrame, row_id: str, threshold: float, version: int) -> DataFrame:
    probability = _positive(model)
    return model.transform(df).select(
        row_id, probability.alias("probability"), (probability >= threshold).alias("decision"),
        F.lit(version).alias("model_version"),
    )


def save_model(model: PipelineModel | TreeModel, path: str, metadata: dict) -> None:
    """Persist the model and, beside it, one row of metadata (threshold, metrics, versions)."""
    spark = SparkSession.active()
    if isinstance(model, TreeModel):
        model.save(f"{path}/trees-model")
    else:
        model.write().overwrite().save(f"{path}/model")
    rows = [(str(k), str(v)) for k, v in {**metadata, "_kind": "trees" if isinstance(model, TreeModel) else "pipeline"}.items()]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel | TreeModel, dict[str, str]]:
    meta = {r["key"]: r["value"] for r in spark.read.json(f"{path}/metadata").collect()}
    kind = meta.pop("_kind")
    return TreeModel.load(spark, f"{path}/trees-model") if kind == "trees" else PipelineModel.load(f"{path}/model"), meta
