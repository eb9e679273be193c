"""Kernels against their definitions."""

import random
import statistics

import numpy as np
import pytest

from opsmetrics.functions.windows import autocorrelation, rolling_trend, sliding_mean, sliding_median, strongest_peak


@pytest.mark.parametrize("n", [2, 3, 17, 128, 500])
def test_autocorrelation(n):
    rng = random.Random(n)
    x = np.array([rng.gauss(5, 3) + 4 * np.sin(i / 3) for i in range(n)])
    c = x - x.mean()
    want = [sum(c[i] * c[i + lag] for i in range(n - lag)) / sum(c * c) for lag in range(n)]
    assert np.allclose(autocorrelation(x, n - 1), want, atol=1e-10)
    assert autocorrelation(np.full(n, 2.5), n - 1) is None


def test_strongest_peak():
    wave = np.sin(np.arange(240) * 2 * np.pi / 24)
    assert strongest_peak(wave, 3, 0.35)[0] == 24
    assert strongest_peak(wave[:5], 3, 0.35) == (None, None)
    assert strongest_peak(np.arange(60.0), 3, 0.99) == (None, None)
    assert strongest_peak(np.ones(60), 3, 0.35) == (None, None)


@pytest.mark.parametrize(("n", "half"), [(1, 2), (4, 2), (5, 2), (40, 3), (60, 45)])
def test_sliding(n, half):
    rng = random.Random(n)
    x = [float(rng.randrange(6)) for _ in range(n)]  # with ties
    cut = [x[max(0, i - half):i + half + 1] for i in range(n)]
    assert sliding_median(x, half).tolist() == [statistics.median(w) for w in cut]
    assert np.allclose(sliding_mean(np.array(x), half), [sum(w) / len(w) for w in cut])


def test_rolling_trend_follows_a_level():
    x = np.concatenate([np.zeros(40), np.full(40, 10.0)])
    x[20] = 1000.0  # one spike does not show
    trend = rolling_trend(x)
    assert abs(trend[20]) < 1e-9 and abs(trend[-1] - 10) < 1e-9
