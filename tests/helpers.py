"""Small frames for the operator tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

DAY = dt.date(2024, 8, 19)
KEY = dict(kpi="k", region="Delhi", window_start=DAY)

EVIDENCE = ("kpi string, region string, window_start date, component string, driver string, ordinal int, "
            "evidence_mode string, model_status string, softmax_probability double, normalized_score double, "
            "evidence_score double, baseline_value double, incident_value double, direction_consistency string, "
            "is_significant boolean, causal_role string, mediates_through string, expected_effect_sign string, "
            "historical_lag_correlation double, historical_coefficient double, best_lag_days int, driver_zscore double, "
            "structural_break_score double")
NAMES = [c.strip().split(" ")[0] for c in EVIDENCE.split(",")]


def evidence(spark, *rows):
    base = dict(KEY, component="c", evidence_mode="historical_relationship", model_status="fitted",
                softmax_probability=.5, normalized_score=.5, evidence_score=.4, baseline_value=100.0, incident_value=100.0,
                direction_consistency=None, is_significant=True, causal_role="direct", mediates_through=None,
                expected_effect_sign="unknown", historical_lag_correlation=0.5, historical_coefficient=1.0,
                best_lag_days=0, driver_zscore=0.0, structural_break_score=0.0)
    return spark.createDataFrame([tuple({**base, "ordinal": i, **r}[n] for n in NAMES) for i, r in enumerate(rows)], EVIDENCE)


def impacts(spark, *rows):
    return spark.createDataFrame(
        [("k", "Delhi", DAY, c, i, float(v), float(b), float(n)) for i, (c, v, b, n) in enumerate(rows)],
        "kpi string, region string, window_start date, component string, ordinal int, impact double, baseline double, incident double")


def packet(spark, **more):
    row = dict(KEY, decision_type="investigate", confidence_level="High", healthy=True, stale_sources=[], missing_sources=[],
               narrative_mode="standard", is_volatile=False, percent_change=-0.2, total_change=-20.0,
               top_probability_gap=0.5, top2_probability_mass=0.9, any_driver_significant=True, freshness_caveat=None)
    row.update(more)
    return spark.createDataFrame([row], "kpi string, region string, window_start date, decision_type string, "
                                 "confidence_level string, healthy boolean, stale_sources array<string>, "
                                 "missing_sources array<string>, narrative_mode string, is_volatile boolean, "
                                 "percent_change double, total_change double, top_probability_gap double, "
                                 "top2_probability_mass double, any_driver_significant boolean, freshness_caveat string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def pairs(spark, days, x, y, cadence=1, max_lag=0, start=DAY, history=None):
    """Pair rows of one driver; days before ``history`` rows count as history."""
    rows = [("k", "Delhi", start, "c", "d", 0, max_lag, cadence, -(-max_lag // cadence), max_lag, d, r, xv, yv)
            for d, r, xv, yv in zip(days, history, x, y)]
    return spark.createDataFrame(rows, "kpi string, region string, window_start date, component string, driver string, "
                                 "ordinal int, max_lag int, cadence int, steps int, context_days int, metric_date date, "
                                 "role string, x double, y double")


def lit(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
