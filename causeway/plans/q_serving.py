"""Read-side queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators import bundle as U
from causeway.operators import serving as V
from causeway.operators.series import INCIDENT
from causeway.plans import refresh as R
from causeway.plans.catalog import query, show
from causeway.plans.workspace import Workspace
from causeway.sources.tables import recent_telemetry as last_telemetry

KEYS = "kpi region window_start"


def found(w: Workspace) -> DataFrame:
    return w.incidents.select("kpi", "region", F.col("window_start").alias("changepoint_date"))


def stored_frames(w: Workspace) -> dict[str, DataFrame]:
    return {"changepoints": found(w), "decomposition": w.decomposed, "driver_evidence": w.evidence,
            "retrieved_context": w.retrieved, "decision_packets": w.packets,
            "orchestrator_updates": w.fused.join(w.web_plans.select(*INCIDENT), INCIDENT, "left_semi"),
            "evidence_bundle": w.bundles}


@query
def coverage_matrix(w: Workspace) -> DataFrame:
    return V.coverage(w.mart, w.contracts, found(w), w.packets)


@query
def kpi_summary(w: Workspace) -> DataFrame:
    covered = V.coverage(w.mart, w.contracts, found(w), w.packets)
    return V.kpi_summary(covered, w.packets, w.evidence, w.actions).drop("recommendation")


@query
def dashboard_counters(w: Workspace) -> DataFrame:
    covered = V.coverage(w.mart, w.contracts, found(w), w.packets)
    return V.counters(V.kpi_summary(covered, w.packets, w.evidence, w.actions))


@query
def business_evidence(w: Workspace) -> DataFrame:
    return show(V.business_evidence(w.evidence), f"{KEYS} possible_driver what_it_can_explain evidence_type "
                "historical_lead_time statistical_check_passed evidence_availability",
                "typical_historical_level:5 incident_level:5 relative_evidence_weight_pct:4")


@query
def weight_shift(w: Workspace) -> DataFrame:
    return show(V.weight_shift(w.fused), f"{KEYS} component driver", "probability_before:5 probability_after:5")


@query
def latest_fused_weight(w: Workspace) -> DataFrame:
    """Two audit rows per driver; the later one must win."""
    old = w.evidence.select(*INCIDENT, "driver", F.lit(0.0).alias("probability_after"), F.lit(1).alias("updated_at"))
    new = w.fused.select(*INCIDENT, "driver", F.col("fused_probability").alias("probability_after"), F.lit(2).alias("updated_at"))
    return show(V.latest_fused(w.evidence, old.unionByName(new)), f"{KEYS} component driver", "fused_probability", 5)


@query
def contract_enrichment(w: Workspace) -> DataFrame:
    legacy = w.evidence.drop("source_cadence_days", "lag_resolution_days", "causal_role").withColumn(
        "expected_effect_sign", F.lit(None).cast("string"))
    return show(V.enrich(legacy, w.drivers), f"{KEYS} component driver source_cadence_days causal_role mediates_through "
                "expected_effect_sign")


@query
def recent_telemetry(w: Workspace) -> DataFrame:
    return last_telemetry(w.facts.telemetry).select("event_id", "operation_name", "latency_ms", "status")


@query
def artifact_counts(w: Workspace) -> DataFrame:
    return V.artifact_counts(stored_frames(w))


def long_frame(df: DataFrame, frame: str, item: Column, fields: dict[str, str | Column]) -> DataFrame:
    """(frame, kpi, region, window_start, item, field, number): one row for each figure."""
    cells = F.array(*[F.struct(F.lit(n).alias("field"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("number")) for n, c in fields.items()])
    return df.select(F.lit(frame).alias("frame"), *INCIDENT, item.cast("string").alias("item"), F.explode(cells).alias("c")) \
        .select("frame", *INCIDENT, "item", "c.field", "c.number")


@query
def dashboard_frames(w: Workspace) -> DataFrame:
    """The seven stored frames of the dashboard, for every KPI and region, one figure a row."""
    frames = stored_frames(w)
    pair, none = F.concat_ws(":", "component", "driver"), F.lit("")
    parts = [
        long_frame(frames["changepoints"].withColumnRenamed("changepoint_date", "window_start"), "changepoints", none, {"found": F.lit(1)}),
        long_frame(frames["decomposition"], "decomposition", none, {c: c for c in ("total_change", "effect_a", "effect_b", "interaction_effect")}),
        long_frame(frames["driver_evidence"], "driver_evidence", pair, {"evidence_score": "evidence_score", "weight": "softmax_probability"}),
        long_frame(frames["retrieved_context"], "retrieved_context", F.concat_ws(":", "source_index", "hypothesis"), {"support": "support", "confidence": "confidence"}),
        long_frame(frames["decision_packets"], "decision_packets", none, {"percent_change": "percent_change", "gap": "top_probability_gap"}),
        long_frame(frames["orchestrator_updates"], "orchestrator_updates", pair, {"before": "softmax_probability", "after": "fused_probability"}),
        long_frame(frames["evidence_bundle"], "evidence_bundle", none, {"drivers": F.size("bundle.deterministic_evidence.ranked_drivers")}),
    ]
    return show(reduce(lambda a, b: a.unionByName(b), parts), "frame kpi region window_start item field", "number", 4)


@query
def decision_cases(w: Workspace) -> DataFrame:
    return V.decision_cases(w.bundles)


@query
def calibration_cards(w: Workspace) -> DataFrame:
    return show(V.calibration_cards(w.bundles), f"{KEYS} sample_count", "adjustment adjusted_readiness_score")


@query
def evidence_bundle(w: Workspace) -> DataFrame:
    return U.to_documents(w.bundles)


@query
def bundle_round_trip(w: Workspace) -> DataFrame:
    """Bundles written as JSON and parsed again, counted by what they hold."""
    docs = U.to_documents(w.bundles)
    back = U.from_documents(docs)
    return back.select(*INCIDENT, F.col("bundle.decision.action_context.action_level").alias("action_level"),
                       F.size("bundle.deterministic_evidence.ranked_drivers").cast("bigint").alias("n_drivers"),
                       F.size("bundle.decomposition.components").cast("bigint").alias("n_components"))


@query
def narratives(w: Workspace) -> DataFrame:
    return w.narration.select(*INCIDENT, "persona", "headline", "narrative", F.array_join("caveats", " | ").alias("caveats"),
                              "leaked")


@query
def refresh_feedback(w: Workspace) -> DataFrame:
    fresh = R.refresh_feedback(w.bundles, w.feedback, w.cutoff)
    return show(V.calibration_cards(fresh), f"{KEYS} sample_count", "adjustment adjusted_readiness_score")


@query
def refresh_wording(w: Workspace) -> DataFrame:
    updates = w.fused.select(*INCIDENT, "driver", F.col("fused_probability").alias("probability_after"), F.lit(1).alias("updated_at"))
    fresh = R.refresh_wording(w.bundles, w.drivers, updates, w.playbook_rows, w.feedback, w.cutoff)
    act = "bundle.decision.action_context"
    return fresh.select(*INCIDENT, *[F.col(f"{act}.{c}").alias(c) for c in ("action_level", "primary_driver", "secondary_driver")])


@query
def refresh_external(w: Workspace) -> DataFrame:
    fresh = R.refresh_external(w.bundles, w.policy_rows, w.anchors, w.playbook_rows, w.feedback, w.cutoff, w.sources,
                               w.raw_assessments)
    return show(fresh.select(*INCIDENT, F.explode("bundle.deterministic_evidence.ranked_drivers").alias("r"))
                .select(*INCIDENT, "r.component", "r.driver", "r.fused_probability"),
                f"{KEYS} component driver", "fused_probability", 5)


@query
def incident_report(w: Workspace) -> DataFrame:
    """The full run: detected changepoints, fitted model, external evidence, feedback and text."""
    d = w.detected
    return d.narration.filter("persona = 'Executive'").join(d.packets.select(*INCIDENT, "confidence_level"), INCIDENT).select(
        *INCIDENT, "confidence_level", "headline", "narrative")
