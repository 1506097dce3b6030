"""Histogram trees on NumPy arrays: leaf-wise growth, boosting and forests over one bounded training table.

Columns are cut into at most 255 bins once; a tree then works on bin numbers. The
leaf of largest gain is split next, until the tree has its number of leaves, so
trees are as deep as the data ask. The histogram of the larger child of a split
is that of its parent less the smaller child's. The module holds NumPy only, so
workers load it without a Spark session.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace

import numpy as np

MAX_BINS = 255


@dataclass(frozen=True)
class Growth:
    """Settings of boosted trees and forests. ``columns`` is the share of columns a tree (a forest: a split) chooses from."""

    rounds: int = 300
    rate: float = 0.05
    leaves: int = 31
    min_rows: int = 20
    l2: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    seed: int = 0


def bin_edges(x: np.ndarray, bins: int = MAX_BINS) -> list[np.ndarray]:
    """Per column the upper edges of its bins: between all distinct values, or at quantiles where those are too many."""
    out = []
    for column in x.T:
        values = np.unique(column[~np.isnan(column)])
        if len(values) > bins:
            values = np.unique(np.quantile(column[~np.isnan(column)], np.linspace(0, 1, bins), method="inverted_cdf"))
        out.append((values[:-1] + values[1:]) / 2)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers; a missing value lies above all edges."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], side="left")
    return out


@dataclass
class Trees:
    """Fitted trees one after another: a node's column (-1: leaf), last bin of its left side, children, value; first nodes of trees."""

    edges: list[np.ndarray]
    column: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    kind: str  # how the trees' sum becomes a prediction: logistic, mean or plain

    def predict(self, x: np.ndarray, rows: int = 2048) -> np.ndarray:
        return np.concatenate([self._predict(x[i : i + rows]) for i in range(0, len(x), rows)] or [np.zeros(0)])

    def _predict(self, x: np.ndarray) -> np.ndarray:
        bins, at = binned(x, self.edges), np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        while True:
            column = self.column[at]
            if (column < 0).all():
                break
            goes_left = bins[row, np.maximum(column, 0)] <= self.bin[at]
            at = np.where(column < 0, at, np.where(goes_left, self.left[at], self.right[at]))
        total = self.value[at].sum(1)
        if self.kind == "mean":
            return total / max(len(self.roots), 1)
        return 1 / (1 + np.exp(-self.base - total)) if self.kind == "logistic" else self.base + total

    def to_arrays(self) -> dict[str, np.ndarray]:
        """Plain arrays, from which ``from_arrays`` builds the model again."""
        flat = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("edges", "base", "kind")}
        sizes = np.array([len(e) for e in self.edges])
        return flat | {"edges": np.concatenate([*self.edges, np.zeros(0)]), "edge_counts": sizes, "base": np.array([self.base])}

    @classmethod
    def from_arrays(cls, kind: str, **a: np.ndarray) -> Trees:
        edges = np.split(a.pop("edges"), np.cumsum(a.pop("edge_counts"))[:-1])
        return cls(edges=edges, base=float(a.pop("base")[0]), kind=kind, **a)


@dataclass
class _Tree:
    """Nodes of the tree that grows."""

    column: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf(self, value: float) -> int:
        for held, v in ((self.column, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, value)):
            held.append(v)
        return len(self.value) - 1


class _Grower:
    """Grows trees over one binned table."""

    def __init__(self, bins: np.ndarray, edges: list[np.ndarray]):
        self.n, self.columns = bins.shape
        self.width = max((len(e) for e in edges), default=0) + 1
        self.bins = np.ascontiguousarray(bins)
        self.flat = bins.astype(np.int32) + np.arange(self.columns, dtype=np.int32) * self.width

    def histogram(self, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        """Sums of (gradient, hessian, rows) per column and bin."""
        places, size = self.flat[rows].ravel(), self.columns * self.width
        out = np.stack([
            np.bincount(places, np.repeat(grad[rows], self.columns), size),
            np.bincount(places, np.repeat(hess[rows], self.columns), size),
            np.bincount(places, minlength=size),
        ])
        return out.reshape(3, self.columns, self.width)

    def best(self, h: np.ndarray, allowed: np.ndarray, g: Growth) -> tuple[float, int, int]:
        """(gain, column, bin) of the best split of a node; gain 0 if there is none."""
        left = np.cumsum(h[:, allowed], axis=2)
        total = left[:, :1, -1:]
        right = total - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / (left[1] + g.l2) + right[0] ** 2 / (right[1] + g.l2) - total[0] ** 2 / (total[1] + g.l2)
        gain = np.where((left[2] >= g.min_rows) & (right[2] >= g.min_rows) & (left[1] > 1e-9) & (right[1] > 1e-9), gain, 0.0)
        at = int(np.argmax(gain))
        column, place = divmod(at, self.width)
        return float(gain[column, place]), int(allowed[column]), place

    def grow(self, rows, grad, hess, g: Growth, rng: np.random.Generator, per_split: bool = False) -> tuple[_Tree, list]:
        """A tree over ``rows`` and its leaves as (node, rows)."""
        tree, heap, leaves = _Tree(), [], {}
        pool = np.sort(rng.choice(self.columns, max(1, round(g.columns * self.columns)), replace=False))

        def put(rows: np.ndarray, h: np.ndarray) -> int:
            weight = h[1, 0].sum() + g.l2
            node = tree.leaf(-h[0, 0].sum() / weight if weight > 0 else 0.0)
            leaves[node] = rows
            if len(rows) >= 2 * g.min_rows:
                allowed = np.sort(rng.choice(self.columns, len(pool), replace=False)) if per_split else pool
                gain, column, place = self.best(h, allowed, g)
                if gain > 1e-12:
                    heapq.heappush(heap, (-gain, node, column, place, h))
            return node

        put(rows, self.histogram(rows, grad, hess))
        while heap and len(leaves) < g.leaves:
            _, node, column, place, h = heapq.heappop(heap)
            held = leaves.pop(node)
            low = self.bins[held, column] <= place
            sides = [held[low], held[~low]]
            small = int(len(sides[0]) > len(sides[1]))
            hists = [None, None]
            hists[small] = self.histogram(sides[small], grad, hess)
            hists[1 - small] = h - hists[small]
            tree.column[node], tree.bin[node] = column, place
            tree.left[node], tree.right[node] = put(sides[0], hists[0]), put(sides[1], hists[1])
        return tree, list(leaves.items())


def _joined(parts: list[_Tree], edges: list[np.ndarray], base: float, kind: str) -> Trees:
    sizes = np.array([len(t.value) for t in parts], np.int64)
    roots = np.cumsum(sizes) - sizes
    flat = lambda name, kind, shift: np.concatenate(
        [np.zeros(0, kind), *(np.asarray(getattr(t, name), kind) + (r if shift else 0) for t, r in zip(parts, roots, strict=True))]
    ).astype(kind)
    return Trees(
        edges, flat("column", np.int32, False), flat("bin", np.int32, False), flat("left", np.int64, True),
        flat("right", np.int64, True), flat("value", np.float64, False), roots, base, kind,
    )


def _reach(tree: _Tree, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The tree's values of ``rows``."""
    column, place = np.array(tree.column), np.array(tree.bin)
    left, right, at = np.array(tree.left), np.array(tree.right), np.zeros(len(rows), np.int64)
    while (inner := column[at] >= 0).any():
        here, which = at[inner], rows[inner]
        at[inner] = np.where(bins[which, column[here]] <= place[here], left[here], right[here])
    return np.array(tree.value)[at]


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, g: Growth = Growth(), kind: str = "logistic") -> Trees:
    """Boosted trees for labels 0/1 (``logistic``) or numbers (``plain``); every round sees its own share of rows and columns."""
    weight = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    y, edges, rng = np.asarray(y, float), bin_edges(x), np.random.default_rng(g.seed)
    grower = _Grower(binned(x, edges), edges)
    base = float(np.average(y, weights=weight)) if len(y) else 0.0
    if kind == "logistic":
        base = float(np.log(np.clip(base, 1e-9, 1 - 1e-9) / (1 - np.clip(base, 1e-9, 1 - 1e-9))))
    score, parts, every = np.full(len(y), base), [], np.arange(len(y))
    for _ in range(g.rounds if len(y) else 0):
        if kind == "logistic":
            p = 1 / (1 + np.exp(-score))
            grad, hess = weight * (p - y), weight * p * (1 - p)
        else:
            grad, hess = weight * (score - y), weight
        bag = every if g.rows >= 1 else np.sort(rng.choice(len(y), max(1, round(g.rows * len(y))), replace=False))
        tree, leaves = grower.grow(bag, grad, hess, g, rng)
        tree.value = [g.rate * v for v in tree.value]
        parts.append(tree)
        for node, rows in leaves:
            score[rows] += tree.value[node]
        if len(bag) < len(y):
            out = np.setdiff1d(every, bag, assume_unique=True)
            score[out] += _reach(tree, grower.bins, out)
    return _joined(parts, edges, base, kind)


def forest_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, g: Growth, numbers: Iterator[int]) -> Iterator[_Tree]:
    """Trees of a forest by number: each on a bootstrap of the rows, every split choosing from its own columns.

    For labels 0/1 the gain is the fall in Gini impurity; a leaf's value is its weighted share of ones.
    """
    edges = bin_edges(x)
    grower = _Grower(binned(x, edges), edges)
    y, g = np.asarray(y, float), replace(g, columns=max(1, int(np.sqrt(x.shape[1]))) / x.shape[1])
    for number in numbers:
        rng = np.random.default_rng((g.seed, number))
        rows = np.sort(rng.integers(0, len(y), len(y)))
        yield grower.grow(rows, -weight * y, weight, g, rng, per_split=True)[0]


def joined_forest(parts: list[_Tree], x: np.ndarray) -> Trees:
    return _joined(parts, bin_edges(x), 0.0, "mean")


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half."""
    values, at = np.unique(score, return_inverse=True)
    ones, all_ = np.bincount(at, y, len(values)), np.bincount(at, minlength=len(values))
    zeros = all_ - ones
    below = np.cumsum(zeros) - zeros
    return float((ones * (below + zeros / 2)).sum() / max(ones.sum() * zeros.sum(), 1))
