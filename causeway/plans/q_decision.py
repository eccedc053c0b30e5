"""Queries over source health, confidence, actions and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators import action as A
from causeway.operators import decision as C
from causeway.operators import health as H
from causeway.operators.series import INCIDENT
from causeway.plans.catalog import query, show
from causeway.plans.workspace import Workspace

KEYS = "kpi region window_start"


def joined(*names: str):
    return [F.array_join(n, ",").alias(n) for n in names]


@query
def source_dependencies(w: Workspace) -> DataFrame:
    return w.required


@query
def source_health_asof(w: Workspace) -> DataFrame:
    return show(w.health_as_of, f"{KEYS} source_name health_date status", "observed_lag_hours completeness_pct")


@query
def missing_sources(w: Workspace) -> DataFrame:
    return H.missing_sources(w.health_as_of)


@query
def source_health_verdict(w: Workspace) -> DataFrame:
    return w.verdicts.select(*INCIDENT, *joined("observed_sources", "missing_sources", "stale_sources"), "healthy",
                             "health_status", "freshness_gap_days")


@query
def component_rank(w: Workspace) -> DataFrame:
    return show(C.component_order(w.impacts), f"{KEYS} component component_rank")


@query
def driver_rank(w: Workspace) -> DataFrame:
    return show(C.driver_order(w.evidence), f"{KEYS} component driver driver_rank")


@query
def top2_gap(w: Workspace) -> DataFrame:
    return show(w.packets, f"{KEYS} evidence_component any_driver_significant",
                "top2_probability_mass top_probability_gap", 5)


@query
def confidence_label(w: Workspace) -> DataFrame:
    return w.packets.select(*INCIDENT, "decision_type", "confidence_level")


@query
def decision_packet(w: Workspace) -> DataFrame:
    return show(w.packets, f"{KEYS} decision_type confidence_level healthy freshness_caveat", "percent_change", 5)


@query
def direction_class(w: Workspace) -> DataFrame:
    move = A.move_class(F.col("baseline_value"), F.col("incident_value"))
    return w.evidence.withColumn("move", move).select(*INCIDENT, "component", "driver", "move")


@query
def action_context(w: Workspace) -> DataFrame:
    return w.actions.select(
        *INCIDENT, "action_level", "primary_driver", "primary_component", "driver_direction", "component_direction",
        "secondary_driver", "is_ambiguous", "movement_status", "direction_alignment", "validation_reason",
        "leading_explanation_driver", "upstream_driver", "owner", "evidence_confidence", "action_readiness")


@query
def action_texts(w: Workspace) -> DataFrame:
    return w.actions.select(*INCIDENT, "finding", "why_it_matters", "next_check", "action_if_confirmed",
                            "recommended_action", "secondary_check", "mechanism_chain")


@query
def base_readiness(w: Workspace) -> DataFrame:
    return show(w.actions.withColumn("base_readiness_score", A.base_readiness(F.col("action_level"))),
                f"{KEYS} action_level", "base_readiness_score")


@query
def feedback_dispositions(w: Workspace) -> DataFrame:
    from causeway.operators import feedback as B
    return B.accepted(w.feedback).agg(F.count("*").alias("n")).withColumn("status", F.lit("accepted")).unionByName(
        B.rejected(w.feedback).agg(F.count("*").alias("n")).withColumn("status", F.lit("rejected")))


@query
def feedback_calibration(w: Workspace) -> DataFrame:
    return show(w.calibration, f"{KEYS} applied sample_count same_region_count reason",
                "effective_sample_size weighted_mean reliability adjustment base_readiness_score "
                "adjusted_readiness_score")
