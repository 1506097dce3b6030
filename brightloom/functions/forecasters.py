"""Forecasters on one training array: ``f(y, horizon) -> horizon values``.

This is the extension point for models; any such function can be handed to
the backtest and forecast jobs. A forecaster whose attribute ``dated`` is true
is called with the last training day as well. The module holds plain NumPy only,
so workers load it without a Spark session.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np

from brightloom.functions import fixed
from brightloom.functions.trees import Growth, boost

Forecaster = Callable[..., np.ndarray]


def ahead(f: Forecaster, y: np.ndarray, horizon: int, last_day: dt.date) -> np.ndarray:
    return np.asarray(f(y, horizon, last_day) if getattr(f, "dated", False) else f(y, horizon), float)


def seasonal_naive(y: np.ndarray, horizon: int, season: int = fixed.SEASON) -> np.ndarray:
    if len(y) < season:
        raise ValueError(f"{len(y)} values do not fill a season of {season}")
    return np.resize(y[-season:], horizon)


def holt_winters(y: np.ndarray, horizon: int, season: int = fixed.SEASON) -> np.ndarray:
    """Additive damped-trend exponential smoothing; the smoothing grid is searched in parallel arrays."""
    if len(y) < 2 * season:
        raise ValueError(f"{len(y)} values do not fill two seasons of {season}")
    grid = np.array(list(product((0.05, 0.1, 0.2, 0.4), (0.0, 0.01, 0.05), (0.05, 0.1, 0.3), (0.9, 0.98))))
    alpha, beta, gamma, phi = grid.T
    first, second = y[:season], y[season : 2 * season]
    level = np.full(len(grid), first.mean())
    trend = np.full(len(grid), (second.mean() - first.mean()) / season)
    seasonal = np.tile((first - first.mean())[:, None], (1, len(grid)))
    sse = np.zeros(len(grid))
    for t, value in enumerate(y):
        slot = seasonal[t % season]
        damped = phi * trend
        error = value - (level + damped + slot)
        if t >= season:
            sse += error * error
        level = level + damped + alpha * error
        trend = damped + beta * alpha * error
        seasonal[t % season] = slot + gamma * (1 - alpha) * error
    best = int(np.argmin(sse))
    steps = np.arange(1, horizon + 1)
    damp = np.cumsum(phi[best] ** steps)
    return level[best] + damp * trend[best] + seasonal[(len(y) + steps - 1) % season, best]


def _calendar(days: np.ndarray) -> np.ndarray:
    """The calendar features of ``operators.series`` for an array of days."""
    month, year = days.astype("datetime64[M]"), days.astype("datetime64[Y]")
    angle = ((days - year).astype(int) + 1) * 2 * np.pi / fixed.DAYS_PER_YEAR
    weekday = (days.astype(int) + 3) % 7  # 1 January 1970 was a Thursday
    last = (month + 1).astype("datetime64[D]") - 1
    parts = (weekday, month.astype(int) % 12 + 1, weekday >= 5, days == month, days == last, np.sin(angle), np.cos(angle))
    return np.column_stack(parts).astype(float)


def _past(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lags and rolling statistics of the days before each place ``at``."""
    parts = [y[at - k] for k in fixed.LAGS]
    for w in fixed.ROLL_WINDOWS:
        held = np.lib.stride_tricks.sliding_window_view(y, w)[at - w]
        parts += [held.mean(1), held.std(1, ddof=1)]
    return np.column_stack(parts)


@dataclass(frozen=True)
class BoostedSeries:
    """Boosted trees on a series' own lags, rolling statistics and calendar; each forecast day enters the history of the next."""

    growth: Growth = Growth(rounds=300, rate=0.05, leaves=31, min_rows=20)
    dated = True

    def __call__(self, y: np.ndarray, horizon: int, last_day: dt.date) -> np.ndarray:
        reach = max(*fixed.LAGS, *fixed.ROLL_WINDOWS)
        if len(y) < reach + 31:
            raise ValueError(f"{len(y)} values; boosted trees need {reach + 31}")
        days = np.datetime64(last_day, "D") + np.arange(1 - len(y), horizon + 1)
        calendar, at = _calendar(days), np.arange(reach, len(y))
        model = boost(np.hstack([_past(y, at), calendar[at]]), y[at], g=self.growth, kind="plain")
        known = np.append(y, np.zeros(horizon))
        for place in range(len(y), len(known)):
            row = np.hstack([_past(known[: place + 1], np.array([place])), calendar[[place]]])
            known[place] = model.predict(row)[0]
        return known[len(y) :]


FORECASTERS: dict[str, Forecaster] = {
    "seasonal_naive": seasonal_naive, "exp_smoothing": holt_winters, "boosted_trees": BoostedSeries(),
}
