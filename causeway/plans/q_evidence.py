"""Queries over lags, severity, direction and evidence weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators import evidence as E
from causeway.operators import lags as L
from causeway.plans.catalog import query, show
from causeway.plans.workspace import Workspace

PAIR = "kpi region window_start component driver"


@query
def coarse_period_means(w: Workspace) -> DataFrame:
    return show(w.periods.filter("cadence > 1"), f"{PAIR} period", "x y", 5)


@query
def lag_corr(w: Workspace) -> DataFrame:
    return show(w.lag_correlations, f"{PAIR} lag_days overlap", "correlation")


@query
def lag_best(w: Workspace) -> DataFrame:
    return show(w.lags, f"{PAIR} best_lag_days overlap", "historical_lag_correlation")


@query
def trailing_baseline(w: Workspace) -> DataFrame:
    return show(w.signals, PAIR, "baseline_value component_baseline", 5)


@query
def lag_aligned_incident(w: Workspace) -> DataFrame:
    return show(w.signals.withColumn("aligned_rows", F.size("moved_x")), f"{PAIR} aligned_rows",
                "incident_value component_incident", 5)


@query
def robust_zscore(w: Workspace) -> DataFrame:
    return show(w.signals, PAIR, "zscore severity", 5)


@query
def structural_break(w: Workspace) -> DataFrame:
    return show(w.signals, f"{PAIR} is_break", "shift_score history_std", 5)


@query
def direction_consistency(w: Workspace) -> DataFrame:
    return w.signals.select(*PAIR.split(), "direction")


@query
def mediator_weight(w: Workspace) -> DataFrame:
    return show(w.signals, f"{PAIR} causal_role", "mechanism_weight")


@query
def model_sufficiency(w: Workspace) -> DataFrame:
    return show(E.model_sufficiency(w.signals),
                "kpi region window_start component observed n_drivers required model_status")


@query
def usable_series(w: Workspace) -> DataFrame:
    return show(E.usable_series(w.pairs.filter("role = 'history'"), L.PAIR, "x"), f"{PAIR} n_observed is_usable")


@query
def evidence_scores(w: Workspace) -> DataFrame:
    return show(w.evidence, f"{PAIR} evidence_mode model_status direction_consistency is_significant",
                "driver_zscore structural_break_score evidence_score", 5)


@query
def evidence_weights(w: Workspace) -> DataFrame:
    return show(w.evidence, PAIR, "normalized_score softmax_probability", 5)
