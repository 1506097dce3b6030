"""Radix selection against NumPy, on ties, huge ranges, odd numbers and very dense cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.functions import radix

PROBS = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]


def samples():
    rng = random.Random(1)
    return {
        "ties": [rng.choice([0.5, 0.5, rng.random() * 100]) for _ in range(3000)],
        "dense": [1000 + i * 1e-9 for i in range(2000)],  # far more values than parts of a cell
        "range": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(500)],
        "zeros": [0.0, -0.0, 0.0, -1.5, 2.5, 5e-324, -5e-324],
        "one": [3.25] * 5,
        "single": [7.0],
        "halves": [1.0, 2.0],
        "longs": [float(2**53 - i) for i in range(300)],
    }


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, v) for k, values in samples().items() for v in values] + [("none", None), (None, 1.0)]
    return spark.createDataFrame(rows, "k string, v double").repartition(5)


def test_quantiles_equal_numpy(table):
    got = {r["k"]: r["quantiles"] for r in radix.quantiles(table, ["k"], "v", PROBS).collect()}
    assert set(got) == set(samples())
    for k, values in samples().items():
        assert got[k] == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12, abs=1e-300), k


def test_quantiles_of_weights_and_without_keys(spark, table):
    counted = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 6)], "v double, n long")
    assert radix.quantiles(counted, [], "v", [0.5, 0.35], "n").first()["quantiles"] == pytest.approx(
        list(np.quantile([1] * 3 + [2] + [9] * 6, [0.5, 0.35])))
    assert radix.quantiles(table.limit(0), ["k"], "v", [0.5]).count() == 0
    ints = spark.range(1, 1001).select(F.col("id").alias("v"))
    assert radix.quantiles(ints, [], "v", [0.5]).first()["quantiles"] == [500.5]


def test_infinite_and_missing_numbers_come_last(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, "inf", "-inf", "nan")], "v double")
    low, middle, high = radix.quantiles(df, [], "v", [0.0, 0.5, 0.75]).first()["quantiles"]
    assert (low, middle, high) == (float("-inf"), 2.0, float("inf"))


def test_cells_keep_the_order(spark):
    values = sorted(v for s in samples().values() for v in s)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    cells = [r["c"] for r in df.select("i", radix.cell_of(F.col("v")).alias("c")).orderBy("i").collect()]
    assert cells == sorted(cells)


def ks(ref, cur):
    pool = np.concatenate([ref, cur])
    f = lambda s: np.searchsorted(np.sort(s), pool, side="right") / len(s)
    return float(np.max(np.abs(f(np.asarray(ref)) - f(np.asarray(cur)))))


def test_distances_equal_numpy(spark):
    rng = np.random.default_rng(3)
    ref = {"normal": rng.normal(0, 1, 900), "dense": 5 + rng.integers(0, 3000, 900) * 1e-10, "ties": rng.integers(0, 4, 900) * 1.0, "alone": rng.random(5)}
    cur = {
        ("normal", "a"): rng.normal(0.2, 1, 400), ("normal", "b"): rng.normal(0, 1, 50), ("dense", "a"): 5 + rng.integers(0, 2500, 600) * 1e-10,
        ("dense", "b"): 5 + rng.integers(500, 3000, 600) * 1e-10, ("ties", "a"): rng.integers(0, 5, 300) * 1.0, ("ties", "b"): ref["ties"], ("new", "a"): rng.random(4),
    }
    left = spark.createDataFrame([(f, float(v)) for f, s in ref.items() for v in s] + [("normal", None)], "feature string, value double")
    right = spark.createDataFrame([(f, w, float(v)) for (f, w), s in cur.items() for v in s], "feature string, window string, value double")
    got = {(r["feature"], r["window"]): r for r in radix.ks_distances(left, right.repartition(3)).collect()}
    assert set(got) == {k for k in cur if k[0] in ref}
    for (f, w), row in got.items():
        assert row["ks_statistic"] == pytest.approx(ks(ref[f], cur[(f, w)]), abs=1e-12), (f, w)
        assert (row["n_reference"], row["n_current"]) == (len(ref[f]), len(cur[(f, w)]))
    assert radix.ks_distances(left.limit(0), right).count() == 0
