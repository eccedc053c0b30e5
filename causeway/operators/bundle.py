"""Evidence bundle: one nested document per incident."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions.text import finite
from causeway.operators.series import INCIDENT

DECOMPOSITION = ["decomposition_type", "effect_a", "effect_b", "interaction_effect", "residual", "total_change",
                 "is_volatile", "narrative_mode"]
HEALTH = ["health_status", "healthy", "observed_sources", "missing_sources", "stale_sources", "freshness_gap_days"]
PACKET = ["percent_change", "total_change", "confidence_level", "top_probability_gap", "top2_probability_mass",
          "evidence_component", "any_driver_significant", "decision_type", "freshness_caveat"]
# The stored document, version 1. Fields are only added; documents of before lack them.
VERSION = 1
BUNDLE = """
kpi string, region string, window_start string,
deterministic_evidence struct<ranked_drivers: array<struct<
  component: string, driver: string, ordinal: int, best_lag_days: int, historical_lag_correlation: double,
  baseline_value: double, incident_value: double, source_cadence_days: int, lag_resolution_days: int, causal_role: string,
  mediates_through: string, expected_effect_sign: string, mechanism_weight: double, evidence_mode: string, model_status: string,
  driver_zscore: double, structural_break_score: double, historical_coefficient: double, holdout_r2: double, p_value: double,
  is_significant: boolean, coefficient_stability: double, incident_severity_strength: double, direction_consistency: string,
  evidence_score: double, normalized_score: double, softmax_probability: double, fused_probability: double,
  retrieval_support: double>>>,
retrieved_evidence array<struct<
  source_index: int, hypothesis: string, source_title: string, source_url: string, support: double, confidence: double,
  reason: string>>,
retrieval_plan struct<
  clarification_question: string, retrieval_query: string, retrieval_target: string, planner_status: string,
  planner_reason: string>,
decomposition struct<
  decomposition_type: string, effect_a: double, effect_b: double, interaction_effect: double, residual: double,
  total_change: double, is_volatile: boolean, narrative_mode: string,
  components: array<struct<ordinal: int, component: string, impact: double, baseline: double, incident: double>>>,
model_validity struct<any_driver_significant: boolean>,
confidence struct<level: string>,
decision struct<
  percent_change: double, total_change: double, confidence_level: string, top_probability_gap: double,
  top2_probability_mass: double, evidence_component: string, any_driver_significant: boolean, decision_type: string,
  freshness_caveat: string,
  source_health: struct<health_status: string, healthy: boolean, observed_sources: array<string>,
    missing_sources: array<string>, stale_sources: array<string>, freshness_gap_days: bigint>,
  action_context: struct<
    action_level: string, primary_driver: string, primary_driver_label: string, primary_component: string,
    primary_component_label: string, owner: string, driver_direction: string, component_direction: string, finding: string,
    why_it_matters: string, next_check: string, action_if_confirmed: string, why: string, recommended_action: string,
    secondary_driver: string, secondary_driver_label: string, secondary_check: string, is_ambiguous: boolean,
    movement_status: string, direction_alignment: string, validation_reason: string, evidence_mode: string,
    best_lag_days: int, driver_baseline_value: double, driver_incident_value: double, kpi_direction: string,
    evidence_confidence: string, action_readiness: string, leading_explanation_driver: string,
    leading_explanation_driver_label: string, action_target_driver: string, action_target_driver_label: string,
    explanation_differs_from_action_target: boolean, upstream_driver: string, upstream_driver_label: string,
    mechanism_chain: string,
    feedback_calibration: struct<
      kpi: string, region: string, window_start: string, matched_primary_driver: string, matched_action_level: string,
      applied: boolean, sample_count: bigint, same_region_count: bigint, effective_sample_size: double,
      weighted_mean: double, reliability: double, adjustment: double, reason: string, base_readiness_score: double,
      adjusted_readiness_score: double, analysis_cutoff: string, demo_feedback_included: boolean, governance: string>>,
  recommended_action: string>,
narration map<string, struct<headline: string, narrative: string, caveats: array<string>>>
"""
PLAN = ["clarification_question", "retrieval_query", "retrieval_target", "planner_status", "planner_reason"]


def finite_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def ranked_drivers(evidence: DataFrame) -> DataFrame:
    """Drivers of an incident by fused weight, as one short array."""
    fields = [c for c in evidence.columns if c not in INCIDENT]
    cell = F.struct((-F.round("fused_probability", 9)).alias("o"), F.col("component").alias("c"), "ordinal",
                    F.struct(*fields).alias("row"))
    return finite_doubles(evidence).groupBy(*INCIDENT).agg(
        F.transform(F.sort_array(F.collect_list(cell)), lambda r: r["row"]).alias("ranked_drivers"))


def bundles(packets: DataFrame, impacts: DataFrame, evidence: DataFrame, actions: DataFrame, plans: DataFrame,
            retrieved: DataFrame, narration: DataFrame) -> DataFrame:
    """(incident, bundle struct). ``actions`` holds the action_context struct with its calibration."""
    parts = finite_doubles(impacts).groupBy(*INCIDENT).agg(F.sort_array(F.collect_list(
        F.struct("ordinal", "component", "impact", "baseline", "incident"))).alias("components"))
    sources = retrieved.groupBy(*INCIDENT).agg(F.sort_array(F.collect_list(F.struct(
        "source_index", "hypothesis", "source_title", "source_url", "support", "confidence", "reason"))).alias("retrieved"))
    told = narration.groupBy(*INCIDENT).agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("persona", F.struct("headline", "narrative", "caveats"))))).alias("narration"))
    planned = plans.select(*INCIDENT, F.struct(*PLAN).alias("plan"))
    df = finite_doubles(packets)
    for other in (ranked_drivers(evidence), parts, actions, planned, sources, told):
        df = df.join(other, INCIDENT, "left")
    return df.select(*INCIDENT, F.struct(
        F.col("kpi"), F.col("region"), F.col("window_start").cast("string").alias("window_start"),
        F.struct("ranked_drivers").alias("deterministic_evidence"),
        F.col("retrieved").alias("retrieved_evidence"), F.col("plan").alias("retrieval_plan"),
        F.struct(*DECOMPOSITION, "components").alias("decomposition"),
        F.struct("any_driver_significant").alias("model_validity"),
        F.struct(F.col("confidence_level").alias("level")).alias("confidence"),
        F.struct(*PACKET, F.struct(*HEALTH).alias("source_health"), "action_context",
                 F.col("action_context.recommended_action").alias("recommended_action")).alias("decision"),
        F.col("narration")).alias("bundle"))


def fields(kind: T.DataType, at: str = "") -> set[str]:
    """Names of all fields inside a nested type."""
    if isinstance(kind, T.ArrayType):
        return fields(kind.elementType, at)
    if isinstance(kind, T.MapType):
        return fields(kind.valueType, at)
    if not isinstance(kind, T.StructType):
        return set()
    return {name for f in kind.fields for name in {f"{at}{f.name}"} | fields(f.dataType, f"{at}{f.name}.")}


def to_documents(df: DataFrame) -> DataFrame:
    """JSON text with the version of its schema; a field that the schema lacks is refused, as no later reader would see it."""
    strange = fields(df.schema["bundle"].dataType) - fields(T.StructType.fromDDL(BUNDLE))
    if strange:
        raise ValueError(f"fields outside version {VERSION}: {', '.join(sorted(strange))}")
    return df.select(*INCIDENT, F.to_json("bundle", {"ignoreNullFields": "false"}).alias("bundle_json"), F.lit(VERSION).alias("schema_version"))


def from_documents(documents: DataFrame) -> DataFrame:
    """Parse stored documents; a malformed one becomes an empty bundle, a field that an older one lacks is null."""
    return documents.withColumn("bundle", F.from_json("bundle_json", T.StructType.fromDDL(BUNDLE), {"mode": "PERMISSIVE"}))
