import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import evidence as E
from causeway.operators import lags as L
from tests.helpers import DAY, KEY, evidence, one, pairs

D = dt.timedelta(days=1)


def aligned(spark, inc, ctx, lag):
    cell = lambda rows: [(d, float(v)) for d, v in rows]
    df = spark.createDataFrame([(cell(inc), cell(ctx), [d for d, _ in inc])],
                               "inc_x array<struct<d:date,v:double>>, context_x array<struct<d:date,v:double>>, targets array<date>")
    return [r["v"] for r in one(df.select(E.aligned_incident(F.lit(lag)).alias("a"))).a]


def test_lag_aligned_incident(spark):
    days = [dt.date(2024, 8, 10) + D * i for i in range(12)]
    ctx = list(zip(days, [10, 10, 50, 55, 60] + [10] * 7))
    inc = list(zip(days[9:], [10, 10, 10]))
    assert aligned(spark, inc, ctx, 7) == [50, 55, 60]
    assert aligned(spark, inc, inc, 0) == [10, 10, 10]
    assert aligned(spark, list(zip(days[9:11], [1, 2])), [], 3) == [1, 2]


def best(spark, p, most):
    return one(L.best_lags(L.lag_correlations(L.period_means(p), most)))


def test_weekly_lag_moves_in_weeks(spark):
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=20), 7)
    days = [dt.date(2024, 1, 1) + D * i for i in range(140)]
    p = pairs(spark, days, x.tolist(), (x + rng.normal(0, .01, 140)).tolist(), 7, 14, history=["history"] * 140)
    assert best(spark, p, 2).best_lag_days in (0, 7, 14)


def brute(x, y, max_lag):
    """The fold over lags, in plain Python."""
    top, out = -1.0, (0, 0.0)
    for k in range(max_lag + 1):
        a = [(x[i - k], y[i]) for i in range(k, len(x)) if x[i - k] is not None and y[i] is not None]
        if len(a) < 15 or len({p for p, _ in a}) < 2 or len({q for _, q in a}) < 2:
            continue
        r = float(np.corrcoef(*zip(*a))[0, 1])
        if abs(r) > top + 0.02:
            top, out = abs(r), (k, r)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_daily_lag_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = [float(v) if rng.random() > .1 else None for v in rng.normal(size=91)]
    y = [(x[i - 4] or 0.0) + float(rng.normal(0, .5)) if i > 3 else float(rng.normal()) for i in range(91)]
    days = [dt.date(2024, 1, 1) + D * i for i in range(91)]
    got = best(spark, pairs(spark, days, x, y, 1, 7, history=["history"] * 91), 7)
    lag, r = brute(x, y, 7)
    assert got.best_lag_days == lag and got.historical_lag_correlation == pytest.approx(r)


def test_structural_break_beats_contradiction(spark):
    hist = [DAY - D * 98 + D * i for i in range(90)]
    inc = [DAY + D * i for i in range(11)]
    roles = ["history"] * 90 + ["incident"] * 11
    y = np.linspace(100, 110, 90).tolist() + [60.0] * 11
    spend = pairs(spark, hist + inc, np.linspace(90, 110, 90).tolist() + [150.0] * 11, y, history=roles)
    stock = pairs(spark, hist + inc, [1.0] * 90 + [0.1] * 11, y, history=roles).withColumn("driver", F.lit("stock"))
    p = spend.withColumn("driver", F.lit("spend")).unionByName(stock)
    dim = spark.createDataFrame([("k", "c", n, "direct", None, "positive") for n in ("spend", "stock")],
                                "kpi string, component string, driver string, causal_role string, mediates_through string, expected_effect_sign string")
    sig = E.signals(E.profiles(p), L.best_lags(L.lag_correlations(L.period_means(p), 0)), dim)
    rows = {r.driver: r for r in E.weights(E.score(sig, E.correlation_model(sig))).collect()}
    assert rows["stock"].evidence_mode == "structural_break" and rows["spend"].direction_consistency == "contradictory"
    assert rows["stock"].softmax_probability > rows["spend"].softmax_probability
    assert sum(r.softmax_probability for r in rows.values()) == pytest.approx(1)


def test_contract_sign_wins(spark):
    d = E.direction_consistency(E.movement(F.lit(34.0), F.lit(50.0)), E.movement(F.lit(20.0), F.lit(30.0)), F.lit(-.3), F.lit("positive"))
    n = E.direction_consistency(F.lit(1), F.lit(1), F.lit(-.3), F.lit("unknown"))
    assert one(spark.range(1).select(d.alias("d"), n.alias("n"))) == ("aligned", "contradictory")


def test_all_zero_scores_are_uniform(spark):
    rows = E.weights(evidence(spark, *[{"driver": n, "evidence_score": 0.0} for n in "abc"]).drop("softmax_probability", "normalized_score"))
    assert [r.softmax_probability for r in rows.collect()] == pytest.approx([1 / 3] * 3)
    with pytest.raises(ValueError):
        E.weights(evidence(spark, {"driver": "a"}), 0)


def test_mediator_discount(spark):
    dim = spark.createDataFrame([("k", "c", "up", "upstream", "mid", "negative"), ("k", "c", "mid", "direct", None, "positive"),
                                 ("k", "c", "lost", "upstream", "absent", "negative")],
                                "kpi string, component string, driver string, causal_role string, mediates_through string, expected_effect_sign string")
    assert {r.driver: r.mechanism_weight for r in E.mechanism(dim).collect()} == {"up": .6, "mid": 1.0, "lost": 1.0}


def test_key_shape():
    assert set(KEY) == {"kpi", "region", "window_start"}


def test_gate_counts_days_on_which_every_driver_has_a_value(spark):
    """Two drivers that miss different days: neither alone is short, together they are."""
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(40)]
    rows = lambda hole: [(d, None if hole(k) else float(k), None if k == 39 else 1.0) for k, d in enumerate(days)]
    signal = spark.createDataFrame(
        [("k", "r", days[0], "c", "even", 0, rows(lambda k: k < 8)), ("k", "r", days[0], "c", "late", 2, rows(lambda k: k >= 30)),
         ("k", "r", days[0], "alone", "even", 0, rows(lambda k: k < 8)), ("k", "r", days[0], "none", "gone", 0, rows(lambda k: True))],
        "kpi string, region string, window_start date, component string, driver string, best_lag_days int, "
        "history_rows array<struct<d:date,x:double,y:double>>")
    got = {r.component: (r.observed, r.n_drivers, r.required, r.model_status) for r in E.model_sufficiency(signal).collect()}
    # even: days 8..38; late, two days on: days 2..31
    assert got == {"c": (24, 2, 30, "insufficient_history"), "alone": (31, 1, 30, "fitted"), "none": (0, 1, 30, "insufficient_history")}
