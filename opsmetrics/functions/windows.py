"""Kernels over one short series: autocorrelation by the power spectrum, sliding median and mean.

Spark partitions the series and hands over Arrow batches of arrays of bounded length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np


def autocorrelation(values: np.ndarray, lags: int) -> np.ndarray | None:
    """Autocorrelation at lags 0 to `lags` of the centred values; null where they are constant.

    The inverse transform of the power spectrum of the zero-padded series, O(n log n) for all lags.
    Rounded to 12 digits, so that equal lags stay equal.
    """
    x = np.asarray(values, dtype=float)
    x = x - x.mean()
    power = float(x @ x)
    if power <= 0:
        return None
    size = 1 << (2 * len(x) - 1).bit_length()
    spectrum = np.fft.rfft(x, size)
    return np.round(np.fft.irfft(spectrum * spectrum.conj(), size)[:lags + 1] / power, 12)


def strongest_peak(values: np.ndarray, min_periods: int, least: float) -> tuple[int | None, float | None]:
    """(lag, height) of the highest local peak above `least` with room for `min_periods` cycles; of
    equal peaks the first."""
    n = len(values)
    longest = n // min_periods
    if n < 2 * min_periods or longest < 2:
        return None, None
    acf = autocorrelation(values, min(longest + 1, n - 1))
    if acf is None:
        return None, None
    at = np.arange(2, longest + 1)
    after = np.append(acf, -1.0)[at + 1]
    peaks = at[(acf[at] > least) & (acf[at] >= acf[at - 1]) & (acf[at] >= after)]
    if not len(peaks):
        return None, None
    best = int(peaks[np.argmax(acf[peaks])])
    return best, float(acf[best])


def sliding_median(values: np.ndarray, half: int) -> np.ndarray:
    """Median of the centred window of 2 half + 1 cells, cut at the ends.

    The window is kept in order: a step takes one value out and puts one in, found by bisection.
    """
    n = len(values)
    held = sorted(values[:half])
    out = np.empty(n)
    for i in range(n):
        if i + half < n:
            insort(held, values[i + half])
        if i - half - 1 >= 0:
            del held[bisect_left(held, values[i - half - 1])]
        m = len(held)
        out[i] = (held[(m - 1) // 2] + held[m // 2]) / 2
    return out


def sliding_mean(values: np.ndarray, half: int) -> np.ndarray:
    """Mean of the same windows, from running sums."""
    n = len(values)
    sums = np.concatenate(([0.0], np.cumsum(values)))
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    return (sums[hi] - sums[lo]) / (hi - lo)


def rolling_trend(values: np.ndarray) -> np.ndarray:
    """Rolling median, then rolling mean, both over an eighth of the series (5 cells at least, made odd)."""
    width = max(5, len(values) // 8)
    half = (width + 1 - width % 2) // 2
    return sliding_mean(sliding_median(list(map(float, values)), half), half)
