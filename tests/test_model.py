"""The model from moments against the kernels that work on whole arrays."""

import datetime as dt
import random

import numpy as np
import pytest

from causeway.functions import kernels as K
from causeway.functions.linear import critical_statistic
from causeway.operators.model import fitted_model
from causeway.operators.resampling import student_p

DAY = dt.date(2024, 3, 1)
PAIRS = "kpi string, region string, window_start date, component string, driver string, ordinal int, best_lag_days int, history_rows array<struct<d:date,x:double,y:double>>"


def walk(rng, n, step):
    out, x = [], 0.0
    for _ in range(n):
        x = x * step + rng.gauss(0, 1)
        out.append(x)
    return out


def signal(spark, cases):
    """cases: {component: (y, [(driver, lag, x), ...])}."""
    rows = [("k", "r", DAY, c, name, i, lag, [(DAY - dt.timedelta(len(y) - j), x[j], y[j]) for j in range(len(y))])
            for c, (y, drivers) in cases.items() for i, (name, lag, x) in enumerate(drivers)]
    return spark.createDataFrame(rows, PAIRS)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    noise, drift, third = walk(rng, 91, 0.2), walk(rng, 91, 1.0), walk(rng, 91, 0.5)
    y = [0.0, 0.0] + [2 * a + rng.gauss(0, 0.5) for a in noise[:-2]]
    gaps = lambda v, k: [None if j % 9 == k else x for j, x in enumerate(v)]
    return {"plain": (y, [("a", 2, noise), ("b", 0, drift), ("c", 1, third)]),
            "gaps": (gaps(y, 1), [("a", 2, gaps(noise, 4)), ("b", 0, gaps(drift, 7))]),
            "flat": ([3.0] * 91, [("a", 0, noise)]), "flat driver": (y, [("a", 0, [7.0] * 91), ("b", 2, noise)]),
            "short": (y[:20], [("a", 0, noise[:20])]), "tiny": (y[:8], [("a", 0, noise[:8])]), "infinite": (y, [("a", 0, [float("inf"), *noise[1:]]), ("b", 2, noise)]),
            "smooth": (y, [("a", 0, [float(j) for j in range(91)]), ("b", 0, [float(j // 7 % 5) for j in range(91)])]), "empty": ([None] * 91, [("a", 0, noise)])}


def slow(y, drivers):
    """The same model by arrays: (differenced of the target, [differenced], fit or None, n)."""
    target, changed = K.stationary(np.array(y, float))
    moved = [K.stationary(np.array(x, float)) for _, _, x in drivers]
    xs = [s.shifted(lag) for (s, _), (_, lag, _) in zip(moved, drivers)]
    ys = target.shifted(0)
    table = np.column_stack([ys, *xs])
    table = table[np.isfinite(table).all(axis=1)]
    usable = target.usable()
    fit = K.fit_component(table[:, 1:], table[:, 0]) if usable else None
    return changed, [c for _, c in moved], fit, (len(table) if usable else 0), xs, ys


def test_model_matches_the_array_kernels(spark, cases):
    model = fitted_model(signal(spark, cases), 3)
    got = {(r["component"], r["driver"]): r for r in model.table.collect()}
    assert len(got) == sum(len(d) for _, d in cases.values())
    for c, (y, drivers) in cases.items():
        changed, moved, fit, n, xs, ys = slow(y, drivers)
        for j, (name, _, _) in enumerate(drivers):
            r = got[c, name]
            assert (r["component_differenced"], r["driver_differenced"]) == (changed, moved[j]), (c, name)
            assert (r["model_status"], r["n_observations"]) == ("fitted" if fit else "insufficient_history", n), (c, name)
            if fit:
                assert r["alpha"] == pytest.approx(fit["alpha"]) and r["historical_coefficient"] == pytest.approx(fit["coef"][j], abs=1e-9)
                assert r["holdout_r2"] == pytest.approx(fit["holdout_r2"])
                both = np.isfinite(xs[j]) & np.isfinite(ys)
                method, p, _ = K.validity(xs[j][both], ys[both], len(xs))
                assert r["validity_method"] == method and (r["p_value"] is None) == (p is None)
                assert p is None or r["p_value"] == pytest.approx(p, abs=1e-9)
                assert 0 <= r["coefficient_stability"] <= 1
            else:
                assert (r["alpha"], r["historical_coefficient"], r["p_value"], r["is_significant"]) == (None, 0.0, None, False)
    assert got["plain", "a"]["coefficient_stability"] == 1.0 and got["plain", "a"]["is_significant"]


def test_statistic_and_order_give_the_kernels_p_value(spark, cases):
    for r in fitted_model(signal(spark, cases), 3).tests.collect():
        y, drivers = cases[r["component"]]
        v = np.array(y if not r["driver"] else next(x for n, _, x in drivers if n == r["driver"]), float)
        clean = v[~np.isnan(v)]
        assert r["n"] == len(clean)
        if r["statistic"] is not None:
            assert K.unit_root_p(r["statistic"]) == pytest.approx(K.adf_p(clean), abs=1e-9)
    assert K.unit_root_p(critical_statistic()) == pytest.approx(K.ADF_ALPHA, abs=1e-9)


def test_draws_repeat_and_intervals_find_an_effect(spark):
    """Drivers of a large scale are judged by drawn intervals."""
    rng = random.Random(3)
    x = [1000 * v for v in walk(rng, 91, 0.1)]
    other = [1000 * v for v in walk(rng, 91, 0.1)]
    frame = signal(spark, {"c": ([v / 500 + rng.gauss(0, 1) for v in x], [("a", 0, x), ("b", 0, other)])})
    one, two = ({r["driver"]: r for r in fitted_model(f, 3).table.collect()} for f in (frame, frame.repartition(3)))
    assert one == two
    assert one["a"]["validity_method"] == "bootstrap" and one["a"]["is_significant"] and not one["b"]["is_significant"]


def test_student_p_matches_the_incomplete_beta(spark):
    from pyspark.sql import functions as F
    rows = [(t, n) for t in (0.0, 0.3, -1.7, 4.2, 40.0) for n in (1, 2, 3, 4, 28, 29, 89)]
    for r in spark.createDataFrame(rows, "t double, n int").withColumn("p", student_p(F.col("t"), F.col("n"))).collect():
        assert r["p"] == pytest.approx(K.student_p(r["t"], r["n"]), abs=1e-12)
