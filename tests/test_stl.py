import numpy as np
import pytest

from opsmetrics.functions.stl import decompose, loess


def naive_loess(y, span, weights, x):
    """One local line by weighted least squares, straight from the definition."""
    n, width = len(y), min(span, len(y))
    near = sorted(range(n), key=lambda i: (abs(i - x), i))[:width]
    reach = max(abs(i - x) for i in near) + max(0, (span - n) // 2)
    w = np.array([weights[i] * (1 - min(abs(i - x) / reach, 1) ** 3) ** 3 for i in near])
    a = np.stack([np.ones(width), np.array(near, dtype=float)], axis=1)
    coef = np.linalg.lstsq(a * np.sqrt(w)[:, None], np.array([y[i] for i in near]) * np.sqrt(w), rcond=None)[0]
    return coef[0] + coef[1] * x


@pytest.mark.parametrize("n,span", [(30, 7), (12, 47), (60, 25)])
def test_loess_is_weighted_local_regression(n, span):
    rng = np.random.default_rng(n)
    y, weights = rng.normal(size=n).cumsum(), rng.uniform(0.2, 1, n)
    got = loess(y, span, weights)
    assert got == pytest.approx([naive_loess(y, span, weights, x) for x in range(n)], abs=1e-6)


def test_parts_add_up_and_a_known_cycle_is_recovered():
    t = np.arange(240)
    cycle = 50 * np.sin(2 * np.pi * t / 24)
    y = 1000 + 0.5 * t + cycle
    trend, seasonal, resid = decompose(y, 24)
    assert np.allclose(trend + seasonal + resid, y)
    assert np.abs(seasonal - cycle).max() < 1 and np.abs(trend - 1000 - 0.5 * t).max() < 1


def test_an_outlier_stays_in_the_residual():
    t = np.arange(240)
    y = 1000 + 50 * np.sin(2 * np.pi * t / 24) + np.random.default_rng(0).normal(0, 1, 240)
    y[120] -= 300
    trend, seasonal, resid = decompose(y, 24)
    assert resid[120] < -280 and np.abs(np.delete(resid, 120)).max() < 10


def test_length_that_is_no_multiple_of_the_period():
    # some noise: without any, robust weights have nothing to measure residuals against
    y = np.sin(np.arange(100) * 2 * np.pi / 7) + np.arange(100) + np.random.default_rng(0).normal(0, 0.1, 100)
    trend, seasonal, resid = decompose(y, 7)
    assert np.allclose(trend + seasonal + resid, y) and np.abs(resid).max() < 0.5
