"""Seasonal-trend decomposition by loess of one short series (Cleveland et al., 1990).

Spark has no loess. This is the whole per-series kernel; Spark partitions the series and
hands over arrays of bounded length. Settings: seasonal window 7, trend window the smallest
odd number above 1.5 p / (1 - 1.5 / 7), low-pass window the smallest odd number above p,
local lines, 2 inner and 15 outer (robust) passes.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

SEASONAL_SPAN = 7
INNER, OUTER = 2, 15


def _odd_above(x: float) -> int:
    n = math.ceil(x)
    return n if n % 2 else n + 1


def _tricube(distance: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Weight 1 near the centre, 0 beyond the reach."""
    ratio = distance / reach
    w = np.where(ratio > 0.999, 0.0, (1.0 - np.clip(ratio, 0.0, 1.0) ** 3) ** 3)
    return np.where(ratio <= 0.001, 1.0, w)


@lru_cache(maxsize=256)
def _neighbourhood(n: int, span: int, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, neighbours, base weights) for fits at -before .. n - 1 + before.

    Each position sees its `span` nearest points; a span beyond the series widens the reach
    instead.
    """
    at = np.arange(-before, n + before, dtype=float)
    width = min(span, n)
    first = np.clip(at.astype(int) - (width - 1) // 2, 0, n - width)
    nearby = first[:, None] + np.arange(width)[None, :]
    reach = np.maximum(at - nearby[:, 0], nearby[:, -1] - at) + max(0, (span - n) // 2)
    return at, nearby, _tricube(np.abs(nearby - at[:, None]), reach[:, None])


def loess(y: np.ndarray, span: int, weights: np.ndarray, before: int = 0) -> np.ndarray:
    """Local weighted lines through each row of y, with `before` extra fits at both ends."""
    n = y.shape[-1]
    if n == 1:
        return np.repeat(y, 1 + 2 * before, axis=-1)
    at, nearby, base = _neighbourhood(n, span, before)
    w = base * weights[..., nearby]
    total = w.sum(axis=-1, keepdims=True)
    seen = total[..., 0] > 0
    w = w / np.where(total > 0, total, 1.0)
    centre = (w * nearby).sum(axis=-1)
    spread = (w * (nearby - centre[..., None]) ** 2).sum(axis=-1)
    sloped = np.sqrt(spread) > 0.001 * (n - 1)
    tilt = np.where(sloped, (at - centre) / np.where(sloped, spread, 1.0), 0.0)
    w = w * (1.0 + tilt[..., None] * (nearby - centre[..., None]))
    fitted = (w * y[..., nearby]).sum(axis=-1)
    # where every neighbour has lost its weight, the value itself stands
    return np.where(seen, fitted, y[..., np.clip(at, 0, n - 1).astype(int)])


def _moving_average(x: np.ndarray, width: int) -> np.ndarray:
    sums = np.cumsum(np.concatenate(([0.0], x)))
    return (sums[width:] - sums[:-width]) / width


def _cycles(detrended: np.ndarray, weights: np.ndarray, period: int) -> np.ndarray:
    """Smooth each phase across the cycles, with one extrapolated value at both ends.

    Phases of equal length are fitted together.
    """
    n = len(detrended)
    whole, longer = divmod(n, period)
    out = np.empty((whole + 3, period))
    for phases, length in ((slice(0, longer), whole + 1), (slice(longer, period), whole)):
        if phases.start == phases.stop:
            continue
        pick = (np.arange(length)[:, None] * period + np.arange(period)[None, phases]).T
        out[: length + 2, phases] = loess(detrended[pick], SEASONAL_SPAN, weights[pick], before=1).T
    return out.reshape(-1)[: n + 2 * period]


def decompose(values, period: int, outer_passes: int = OUTER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, residual); they add up to the values."""
    y = np.asarray(values, dtype=float)
    n = len(y)
    trend_span = _odd_above(1.5 * period / (1 - 1.5 / SEASONAL_SPAN))
    low_span = _odd_above(period + 1)
    ones = np.ones(n)
    trend, seasonal, robust = np.zeros(n), np.zeros(n), ones
    for outer in range(outer_passes + 1):
        for _ in range(INNER):
            cycle = _cycles(y - trend, robust, period)
            low = _moving_average(_moving_average(_moving_average(cycle, period), period), 3)
            low = loess(low, low_span, ones)
            seasonal = cycle[period:-period] - low
            trend = loess(y - seasonal, trend_span, robust)
        if outer < outer_passes:
            size = np.abs(y - trend - seasonal)
            limit = 6.0 * np.median(size)
            if limit <= 0:
                break
            ratio = size / limit
            robust = np.where(ratio >= 0.999, 0.0, (1.0 - np.minimum(ratio, 1.0) ** 2) ** 2)
            robust = np.where(ratio <= 0.001, 1.0, robust)
    return trend, seasonal, y - trend - seasonal
