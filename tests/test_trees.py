"""Histogram trees against a plain version that tries every split of every leaf on the values themselves."""

from dataclasses import replace

import numpy as np
import pytest

from brightloom.functions import trees as tr


def plain_boost(x, y, weight, g, kind):
    """Boosting without bins: every round splits the leaf whose best cut between two values gains most."""
    mean = np.average(y, weights=weight)
    base = np.log(mean / (1 - mean)) if kind == "logistic" else mean
    score, trees = np.full(len(y), base), []

    def fit(rows, grad, hess):
        best = (1e-12, None, None)
        for j in range(x.shape[1]):
            values = np.unique(x[rows, j])
            for cut in (values[:-1] + values[1:]) / 2:
                low = rows[x[rows, j] <= cut]
                high = rows[x[rows, j] > cut]
                if min(len(low), len(high)) < g.min_rows:
                    continue
                part = lambda r: grad[r].sum() ** 2 / (hess[r].sum() + g.l2)
                gain = part(low) + part(high) - part(rows)
                if gain > best[0] + 1e-12:
                    best = (gain, j, cut)
        return best

    for _ in range(g.rounds):
        if kind == "logistic":
            p = 1 / (1 + np.exp(-score))
            grad, hess = weight * (p - y), weight * p * (1 - p)
        else:
            grad, hess = weight * (score - y), weight
        every = np.arange(len(y))
        leaves = [(every, fit(every, grad, hess))]
        while len(leaves) < g.leaves and max(s[0] for _, s in leaves) > 1e-12 and any(s[1] is not None for _, s in leaves):
            at = max((i for i in range(len(leaves)) if leaves[i][1][1] is not None), key=lambda i: leaves[i][1][0])
            rows, (_, j, cut) = leaves.pop(at)
            for side in (rows[x[rows, j] <= cut], rows[x[rows, j] > cut]):
                leaves.append((side, fit(side, grad, hess)))
        for rows, _ in leaves:
            score[rows] -= g.rate * grad[rows].sum() / (hess[rows].sum() + g.l2)
        trees.append(len(leaves))
    return (1 / (1 + np.exp(-score)) if kind == "logistic" else score), trees


@pytest.mark.parametrize("kind,l2", [("logistic", 0.0), ("logistic", 3.0), ("plain", 0.5)])
def test_boosting_equals_the_plain_version(kind, l2):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=200), rng.integers(0, 4, 200), rng.normal(size=200)])
    y = x[:, 0] + (x[:, 1] == 2) * x[:, 2] + rng.normal(0, 0.3, 200)
    y = (y > 0.2).astype(float) if kind == "logistic" else y
    weight, g = rng.uniform(0.5, 2, 200), tr.Growth(rounds=12, rate=0.2, leaves=6, min_rows=8, l2=l2)
    want, leaves = plain_boost(x, y, weight, g, kind)
    model = tr.boost(x, y, weight, g, kind)
    assert model.predict(x) == pytest.approx(want, abs=1e-9)
    assert np.diff(np.append(model.roots, len(model.value))).tolist() == [2 * n - 1 for n in leaves]


def test_settings_bound_the_trees():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(500, 3)), rng.integers(0, 2, 500)
    model = tr.boost(x, y, None, tr.Growth(rounds=7, leaves=9, min_rows=30, rows=0.5, columns=0.7, seed=1))
    sizes = np.diff(np.append(model.roots, len(model.value)))
    assert len(model.roots) == 7 and sizes.max() <= 17
    again = tr.boost(x, y, None, tr.Growth(rounds=7, leaves=9, min_rows=30, rows=0.5, columns=0.7, seed=1))
    assert (model.value == again.value).all()
    other = tr.boost(x, y, None, tr.Growth(rounds=7, leaves=9, min_rows=30, rows=0.5, columns=0.7, seed=2))
    assert len(other.value) != len(model.value) or (other.value != model.value).any()


def test_a_large_penalty_shrinks_and_few_rows_give_no_split():
    x, y = np.arange(20.0)[:, None], (np.arange(20) > 9).astype(int)
    mild, strong = (tr.boost(x, y, None, tr.Growth(rounds=5, min_rows=2, l2=l2)).predict(x).max() for l2 in (0.0, 1e6))
    assert mild > strong > 0.5 - 1e-9 and strong == pytest.approx(0.5, abs=1e-3)
    assert len(tr.boost(x, y, None, tr.Growth(rounds=1, min_rows=11)).value) == 1
    assert tr.boost(x[:0], y[:0], None).predict(x).shape == (20,)


def test_missing_values_and_constant_columns():
    x = np.column_stack([[1.0, np.nan] * 30, np.ones(60)])
    y = np.tile([0, 1], 30)
    model = tr.boost(x, y, None, tr.Growth(rounds=60, rate=0.3, min_rows=5))
    assert len(model.edges[0]) == 0  # one value only: what is missing cannot be told from it by bins
    x = np.column_stack([np.where(np.arange(60) % 3 == 0, np.nan, np.arange(60) % 3), np.ones(60)])
    model = tr.boost(x, (np.arange(60) % 3 == 2).astype(int), None, tr.Growth(rounds=60, rate=0.3, min_rows=5))
    assert tr.auc(model.predict(x), (np.arange(60) % 3 == 2).astype(int)) > 0.7


def test_more_values_than_bins():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5000, 1))
    edges = tr.bin_edges(x)
    assert len(edges[0]) <= tr.MAX_BINS - 1 and np.bincount(tr.binned(x, edges)[:, 0]).max() < 60


def test_forest_equals_plain_trees_on_the_bootstrap():
    rng = np.random.default_rng(6)
    x, weight = rng.normal(size=(150, 1)), np.ones(150)
    y = (x[:, 0] + rng.normal(0, 0.4, 150) > 0).astype(int)
    g = tr.Growth(rounds=3, leaves=1 << 31, min_rows=5, seed=9)
    parts = list(tr.forest_trees(x, y, weight, g, iter(range(3))))
    forest = tr.joined_forest(parts, x)
    want = np.zeros(150)
    for number in range(3):
        rows = np.sort(np.random.default_rng((9, number)).integers(0, 150, 150))
        one, _ = plain_boost_values(x, y, rows, g)
        want += one / 3
    assert forest.predict(x) == pytest.approx(want)
    assert tr.Trees.from_arrays("mean", **forest.to_arrays()).predict(x) == pytest.approx(want)


def plain_boost_values(x, y, rows, g):
    """One tree of shares of ones over the drawn rows, cut between values of the whole table."""
    edges = tr.bin_edges(x)[0]

    def value(held, at):
        best = (1e-12, None)
        for cut in edges:
            low, high = held[x[held, 0] <= cut], held[x[held, 0] > cut]
            if min(len(low), len(high)) >= g.min_rows:
                gain = sum(y[r].sum() ** 2 / len(r) for r in (low, high)) - y[held].sum() ** 2 / len(held)
                if gain > best[0] + 1e-12:
                    best = (gain, cut)
        if best[1] is None:
            return y[held].mean()
        low = x[held, 0] <= best[1]
        return value(held[low] if x[at, 0] <= best[1] else held[~low], at)

    return np.array([value(rows, at) for at in range(len(x))]), None


def test_auc():
    assert tr.auc(np.array([0.1, 0.4, 0.4, 0.8]), np.array([0, 0, 1, 1])) == 0.875
    assert tr.auc(np.zeros(3), np.array([0, 0, 0])) == 0.0
    assert replace(tr.Growth(), rounds=1).rounds == 1
