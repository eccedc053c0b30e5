"""Kernels against brute force and closed forms."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from causeway.functions import kernels as K


def cost(v):
    return float(((v - v.mean()) ** 2).sum())


def exhaustive(v, penalty, min_size=10, jump=5):
    """Best segmentation by plain dynamic programming, without pruning."""
    n = len(v)
    ends = [e for e in range(jump, n, jump) if e >= min_size] + [n]
    best, back = {0: 0.0}, {}
    for e in ends:
        options = [(best[t] + cost(v[t:e]) + penalty, t) for t in best if e - t >= min_size]
        best[e], back[e] = min(options)
    cuts, at = [], n
    while back[at] > 0:
        at = back[at]
        cuts.append(at)
    return cuts[::-1]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(30, 120))
def test_pelt_equals_exhaustive_search(seed, n):
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.normal(m, 1, 40) for m in rng.normal(0, 3, 4)])[:n]
    assert K.pelt(v, 3 * math.log(n)) == exhaustive(v, 3 * math.log(n))


def test_changepoint_found_and_suppressed():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(10, .3, 60), rng.normal(20, .3, 60), rng.normal(26, .3, 60)])
    kept = [i for i, _, _ in K.changepoints(v, np.arange(180), 21)]
    assert kept == [60, 120]
    assert [i for i, _, _ in K.changepoints(v, np.arange(180), 100)] == [60]
    assert K.changepoints(np.ones(80), np.arange(80), 5) == []
    assert K.changepoints(v[:29], np.arange(29), 5) == []


@pytest.mark.parametrize("tau,p", [(-2.86, 0.0502), (-3.43, 0.0100), (-2.57, 0.0994)])
def test_unit_root_surface(tau, p):
    assert K.unit_root_p(tau) == pytest.approx(p, abs=2e-4)


def test_adf_statistic_equals_plain_regression():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 91)
    y, design = K._lagged(x, 3)
    assert np.allclose(y, np.diff(x)[3:]) and np.allclose(design[:, 1], x[3:-1])
    assert np.allclose(design[:, 2], np.diff(x)[2:-1]) and np.allclose(design[:, 4], np.diff(x)[:-3])
    assert K.adf_p(x) < 0.01 and K.adf_p(np.cumsum(x)) > 0.05
    # AIC picks the same lag as separate least-squares fits on the common sample.
    y, full = K._lagged(x, 12)
    aic = []
    for k in range(2, 15):
        b, *_ = np.linalg.lstsq(full[:, :k], y, rcond=None)
        rss = float(((y - full[:, :k] @ b) ** 2).sum())
        aic.append(len(y) * (math.log(2 * math.pi * rss / len(y)) + 1) + 2 * k)
    y2, d2 = K._lagged(x, int(np.argmin(aic)))
    b, *_ = np.linalg.lstsq(d2, y2, rcond=None)
    e = y2 - d2 @ b
    se = math.sqrt(float(e @ e) / (len(y2) - d2.shape[1]) * np.linalg.inv(d2.T @ d2)[1, 1])
    assert K.adf_p(x) == pytest.approx(K.unit_root_p(b[1] / se), abs=1e-9)


def test_degenerate_series_become_zeros_and_walks_are_differenced():
    s, changed = K.stationary(np.ones(40))
    assert changed and not s.usable() and (s.values == 0).all()
    walk = np.cumsum(np.random.default_rng(0).normal(size=91))
    walk[10] = np.nan
    s, changed = K.stationary(walk)
    assert changed and len(s.values) == 88 and 10 not in s.rows and 11 not in s.rows
    assert np.isnan(s.shifted(2)[s.rows[:2]]).all() and s.shifted(2)[s.rows[2]] == s.values[0]


def test_ridge_equals_augmented_least_squares():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    for a, coef, b0 in zip(K.ALPHAS, *K.ridge_path(x, y, K.ALPHAS)):
        xc, yc = x - x.mean(0), y - y.mean()
        big = np.vstack([xc, math.sqrt(a) * np.eye(3)])
        want, *_ = np.linalg.lstsq(big, np.concatenate([yc, np.zeros(3)]), rcond=None)
        assert np.allclose(coef, want) and b0 == pytest.approx(y.mean() - want @ x.mean(0))


def test_component_fit_finds_the_driver():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 2))
    y = 2 * x[:, 0] + rng.normal(0, .1, 80)
    fit = K.fit_component(x, y)
    assert fit["holdout_r2"] > 0.9 and fit["stability"][0] == 1.0 and abs(fit["coef"][0]) > 10 * abs(fit["coef"][1])
    assert K.fit_component(x[:29], y[:29]) is None
    assert K.fit_component(rng.normal(size=(39, 4)), rng.normal(size=39)) is None


@pytest.mark.parametrize("t,df,p", [(2.0, 10, 0.07338803), (0.5, 3, 0.65145), (12.706205, 1, 0.05), (1.959964, 1e7, 0.05)])
def test_student_tail(t, df, p):
    assert K.student_p(t, df) == pytest.approx(p, rel=2e-4)


def test_validity_paths():
    rng = np.random.default_rng(9)
    x = rng.normal(size=60)
    assert K.validity(x, 3 * x + rng.normal(0, .1, 60), 3)[0] == "ols"
    method, p, ok = K.validity(1000 + x, 3 * x + rng.normal(0, .1, 60), 3)
    assert (method, p, ok) == ("bootstrap", None, True)
    assert K.validity(x[:10], x[:10], 1) == ("none", None, False)
    assert K.validity(np.ones(40), x[:40], 1) == ("bootstrap", None, False)


def test_bootstrap_draws_equal_one_call_per_draw():
    one = np.random.default_rng(1337).integers(0, 77, size=(500, 77))
    rng = np.random.default_rng(1337)
    assert (one == np.array([rng.integers(0, 77, size=77) for _ in range(500)])).all()
