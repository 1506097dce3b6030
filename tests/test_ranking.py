import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.functions import ranking as rk


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most of the rows, heavy ties, and a key with a single value."""
    rng = random.Random(1)
    rows = [("hot", rng.choice([0.5, rng.random() * 100])) for _ in range(4000)]
    rows += [("cold", float(i)) for i in range(11)] + [("one", 3.0)] * 5
    return spark.createDataFrame(rows, "k string, v double"), rows


@pytest.mark.parametrize("slices", [2, 40])
def test_running_totals_equal_a_window(skewed, slices):
    df, rows = skewed
    counts = rk.value_counts(df, ["k"], "v")
    got = {(r["k"], r["v"]): (r["cum_n"], r["all_n"]) for r in rk.running_totals(counts, ["k"], "v", ["n"], slices).collect()}
    want = {}
    for key in {k for k, _ in rows}:
        values = np.sort([v for k, v in rows if k == key])
        for v in set(values):
            want[(key, v)] = (int(np.searchsorted(values, v, side="right")), len(values))
    assert got == want


def test_running_totals_without_keys(spark):
    counts = spark.createDataFrame([(3.0, 2), (1.0, 1), (2.0, 5)], "v double, n long")
    got = sorted((r["v"], r["cum_n"], r["all_n"]) for r in rk.running_totals(counts, [], "v", ["n"]).collect())
    assert got == [(1.0, 1, 8), (2.0, 6, 8), (3.0, 8, 8)]


def test_shuffled_rank(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3 == 0).alias("s"))
    rows = rk.shuffled_rank(df, ["s"], "id", 7).collect()
    for flag in (True, False):
        part = [r for r in rows if r["s"] == flag]
        assert sorted(r["rank"] for r in part) == list(range(1, len(part) + 1))
        assert {r["stratum_n"] for r in part} == {len(part)}


def test_row_numbers_big_and_small_groups(spark):
    df = spark.range(500).select(F.when(F.col("id") < 400, "big").otherwise("small").alias("k"), (F.col("id") * 3).alias("o"))
    rows = rk.row_numbers(df, ["k"], "o", big=150).collect()
    for key, first, n in (("big", 0, 400), ("small", 1200, 100)):
        assert [(r["o"], r["row_no"]) for r in sorted(rows, key=lambda r: r["o"]) if r["k"] == key] == [(first + 3 * i, i + 1) for i in range(n)]
