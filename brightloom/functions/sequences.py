"""Sequence kernels for Arrow UDFs: common subsequence, matching blocks, edit-cost maps."""

from __future__ import annotations

import numpy as np
import pandas as pd


def lcs_length(a, b) -> int:
    """Longest common subsequence of two token lists, one machine-word row of bits at a time."""
    if len(a) == 0 or len(b) == 0:
        return 0
    if len(b) < len(a):
        a, b = b, a
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & places.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def lcs_series(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b)], dtype="int32")


#: From this length on, characters that fill more than a hundredth of the second text start no block.
POPULAR_FROM = 200


def _longest_block(a: np.ndarray, b: np.ndarray, usable: np.ndarray) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common block of usable characters, the first in a, then in b.

    One row of block lengths per character of a, over all of b at once. The
    block then grows by whatever characters are equal beside it.
    """
    at_a = at_b = size = 0
    row = np.zeros(len(b) + 1, np.int64)
    for i, char in enumerate(a):
        row[1:] = np.where(usable & (b == char), row[:-1] + 1, 0)
        top = int(row.max(initial=0))
        if top > size:
            at_a, at_b, size = i - top + 1, int(row.argmax()) - top, top
    while at_a and at_b and a[at_a - 1] == b[at_b - 1]:
        at_a, at_b, size = at_a - 1, at_b - 1, size + 1
    while at_a + size < len(a) and at_b + size < len(b) and a[at_a + size] == b[at_b + size]:
        size += 1
    return at_a, at_b, size


def matching_ratio(expected: str | None, actual: str | None) -> float:
    """2 x characters in matching blocks / characters of both, case folded: 1 for equal texts, also for two empty ones.

    The longest common block comes first, then the same on both sides of it.
    """
    a, b = (np.frombuffer((t or "").casefold().encode("utf-32-le"), np.uint32) for t in (expected, actual))
    if not len(a) + len(b):
        return 1.0
    usable = np.ones(len(b), bool)
    if len(b) >= POPULAR_FROM:
        chars, counts = np.unique(b, return_counts=True)
        usable = ~np.isin(b, chars[counts > len(b) // 100 + 1])
    matched, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        low_a, high_a, low_b, high_b = todo.pop()
        if low_a == high_a or low_b == high_b:
            continue
        i, j, size = _longest_block(a[low_a:high_a], b[low_b:high_b], usable[low_b:high_b])
        if size:
            matched += size
            i, j = low_a + i, low_b + j
            todo += [(low_a, i, low_b, j), (i + size, high_a, j + size, high_b)]
    return 2.0 * matched / (len(a) + len(b))


def ratio_series(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([matching_ratio(x, y) for x, y in zip(a, b)], dtype=float)


def edit_map(expected: list[str], actual: list[str]) -> np.ndarray:
    """Edit costs of consuming ``actual`` from every start to every end position in ``expected``.

    The result composes: the map of a whole sequence is the min-plus product
    of the maps of its parts, so a very long sequence can be cut anywhere.
    """
    m = len(expected)
    at = np.arange(m + 1)
    cost = np.where(at[None, :] >= at[:, None], at[None, :] - at[:, None], np.inf)
    keys = np.array(expected, dtype=object)
    for symbol in actual:
        step = cost + 1
        if m:
            match = cost[:, :-1] + (keys != symbol)
            step[:, 1:] = np.minimum(step[:, 1:], match)
        cost = np.minimum.accumulate(step - at, axis=1) + at
    return cost


def edit_distance(expected: list[str], actual: list[str]) -> int:
    """Edit distance alone: one row of costs instead of the whole map."""
    at = np.arange(len(expected) + 1)
    row, keys = at.copy(), np.array(expected, dtype=object)
    for symbol in actual:
        step = row + 1
        if len(keys):
            step[1:] = np.minimum(step[1:], row[:-1] + (keys != symbol))
        row = np.minimum.accumulate(step - at) + at
    return int(row[-1])


def chain(maps: list[np.ndarray]) -> float:
    """Edit distance from the maps of consecutive parts."""
    row = maps[0][0]
    for m in maps[1:]:
        row = (row[:, None] + m).min(axis=0)
    return float(row[-1])
