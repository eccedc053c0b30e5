"""Action context: what to do about one incident, in five levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.wording import (
    ANY_SOURCE, DATA_OWNER, DIRECTION, EVIDENCE_PHRASE, READINESS, S, choose, fill, friendly)
from causeway.operators.decision import component_order, dominant
from causeway.operators.evidence import HISTORICAL, usable
from causeway.operators.series import INCIDENT

# Movement and ambiguity thresholds.
MATERIAL_MOVE = 0.02
SPLIT_GAP = 0.10
SLOPE_FLOOR = 1e-10
BASE_READINESS = {"act": 0.85, "validate": 0.60, "validate_unexplained": 0.45, "monitor": 0.35,
                  "data_quality_first": 0.20}
BASE_DEFAULT = 0.50

CONTEXT = [
    "action_level", "primary_driver", "primary_driver_label", "primary_component", "primary_component_label", "owner",
    "driver_direction", "component_direction", "finding", "why_it_matters", "next_check", "action_if_confirmed", "why",
    "recommended_action", "secondary_driver", "secondary_driver_label", "secondary_check", "is_ambiguous",
    "movement_status", "direction_alignment", "validation_reason", "evidence_mode", "best_lag_days",
    "driver_baseline_value", "driver_incident_value", "kpi_direction", "evidence_confidence", "action_readiness",
    "leading_explanation_driver", "leading_explanation_driver_label", "action_target_driver",
    "action_target_driver_label", "explanation_differs_from_action_target", "upstream_driver",
    "upstream_driver_label", "mechanism_chain"]


def move_class(before: Column, after: Column) -> Column:
    """increased, decreased, unchanged (within 2 %) or unknown."""
    delta, base = after - before, F.abs(before)
    still = F.when(base > 1e-12, F.abs(delta / F.nullif(base, F.lit(0.0))) < MATERIAL_MOVE).otherwise(F.abs(delta) < 1e-12)
    return (
        F.when(before.isNull() | after.isNull() | F.isnan(before) | F.isnan(after), "unknown")
        .when(still, "unchanged").when(delta > 0, "increased").otherwise("decreased")
    )


def alignment(driver_move: Column, component_move: Column) -> Column:
    """The stored direction check; for older rows without one, the sign logic on the spot."""
    sign = F.lower(F.trim(F.coalesce("expected_effect_sign", F.lit("unknown"))))
    lag_slope, fit_slope = F.col("historical_lag_correlation"), F.col("historical_coefficient")
    slope = F.when(F.abs(lag_slope) > SLOPE_FLOOR, lag_slope).when(F.abs(fit_slope) > SLOPE_FLOOR, fit_slope)
    effect = F.when(sign == "positive", 1).when(sign == "negative", -1).otherwise(F.signum(slope))
    way = lambda m: F.when(m == "increased", 1).when(m == "decreased", -1)
    agrees = way(driver_move) * effect == way(component_move)
    computed = F.when((F.col("evidence_mode") != HISTORICAL) | agrees.isNull(), "not_evaluated") \
                .when(agrees, "aligned").otherwise("contradictory")
    stored = F.lower(F.trim("direction_consistency"))
    return F.when(stored.isin("aligned", "contradictory", "not_evaluated"), stored).otherwise(computed)


def candidates(evidence: DataFrame, lead: DataFrame, playbook: DataFrame) -> DataFrame:
    """Per incident the drivers of its primary component, best first, as one short array.

    The array is bounded by the number of drivers the contract declares for a component.
    """
    rows = evidence.join(lead, INCIDENT).filter("component = dominant_component")
    rows = (
        rows.withColumn("move", move_class(F.col("baseline_value"), F.col("incident_value")))
        .withColumn("align", alignment(F.col("move"), move_class(F.col("dominant_baseline"), F.col("dominant_incident"))))
        .withColumn("weight", F.coalesce("fused_probability", "softmax_probability", F.lit(0.0)))
        .withColumn("is_usable", usable())
        .withColumn("has_moved", F.col("move").isin("increased", "decreased"))
        .withColumn("is_actionable", F.col("is_usable") & F.col("has_moved") & (F.col("align") != "contradictory"))
        .join(F.broadcast(playbook.withColumnRenamed("direction", "move")), ["driver", "move"], "left")
    )
    cell = F.struct((-F.round("weight", 9)).alias("order"), "ordinal", "driver", "move", "align", "weight", "is_usable",
                    "has_moved", "is_actionable", "evidence_mode", "is_significant", "causal_role", "mediates_through",
                    "best_lag_days", "baseline_value", "incident_value", "label", "owner", "next_check",
                    "action_if_confirmed", "hidden_check")
    return rows.groupBy(*INCIDENT).agg(F.sort_array(F.collect_list(cell)).alias("all_rows"))


def first(cells: Column) -> Column:
    return F.try_element_at(cells, F.lit(1))


def pick(df: DataFrame) -> DataFrame:
    """Choose explanation, action target, upstream trigger and runner-up from the candidate array."""
    df = df.withColumn("rows", F.filter("all_rows", lambda r: r["is_usable"])) \
           .withColumn("ready", F.filter("all_rows", lambda r: r["is_actionable"]))
    df = df.withColumn("explain", first(F.col("rows"))).withColumn("leader", first(F.col("ready")))
    df = df.withColumn("mediator", F.when(F.col("leader.causal_role") == "upstream", first(
        F.filter("ready", lambda r: r["driver"] == F.col("leader.mediates_through")))))
    df = df.withColumn("chosen", F.coalesce("mediator", "leader"))
    df = df.withColumn("second", first(F.filter("ready", lambda r: r["driver"] != F.col("chosen.driver"))))
    return df.withColumn("upstream", first(F.filter("rows", lambda r: (r["causal_role"] == "upstream") & F.coalesce(
        r["mediates_through"] == F.col("chosen.driver"), F.lit(False)))))


def level() -> Column:
    """Which of the five levels applies, in order of precedence."""
    return (
        F.when(~F.coalesce("healthy", F.lit(False)), "data_quality_first")
        .when(F.lower("decision_type") != "investigate", "monitor")
        .when(F.coalesce(F.size("rows"), F.lit(0)) <= 0, "no_usable_driver")
        .when(F.col("chosen").isNull(), "validate_unexplained").otherwise("moved")
    )


def action_context(packets: DataFrame, evidence: DataFrame, impacts: DataFrame, playbook: DataFrame) -> DataFrame:
    """Flat action context per incident. ``evidence`` may carry fused_probability."""
    if "fused_probability" not in evidence.columns:
        evidence = evidence.withColumn("fused_probability", F.lit(None).cast("double"))
    lead = dominant(impacts)
    df = pick(packets.join(lead, INCIDENT, "left")
              .join(candidates(evidence, lead, playbook), INCIDENT, "left")).withColumn("case", level())
    c, lit = F.col, F.lit
    component, kpi = friendly("dominant_component"), friendly("kpi")
    case = c("case")
    none = lit(None).cast("string")

    # Data-quality texts.
    no_names = F.array().cast("array<string>")
    affected = F.array_join(F.array_union(F.coalesce("stale_sources", no_names), F.coalesce("missing_sources", no_names)),
                            ", ")
    sources = F.when(affected == "", ANY_SOURCE).otherwise(affected)
    health_check = fill(S["health_check"], sources=sources)

    # No usable driver.
    n_all = F.coalesce(F.size("all_rows"), lit(0))
    reason = F.when(n_all <= 0, "driver_coverage_gap").otherwise("insufficient_history")
    kind = F.when(n_all <= 0, "uncovered").otherwise("short")
    gap_text = lambda part: F.when(kind == "uncovered", fill(S[f"uncovered_{part}"], component=component)) \
        .otherwise(fill(S[f"short_{part}"], component=component))

    # Nothing moved.
    clash = F.exists("rows", lambda r: r["has_moved"] & (r["align"] == "contradictory"))
    unknown = F.exists("rows", lambda r: r["move"] == "unknown")
    still = F.when(clash, fill(S["contradicting"], component=component)) \
             .when(unknown, fill(S["incomplete"], component=component)) \
             .otherwise(fill(S["unmoved"], driver=c("explain.label"), component=component,
                             moved=choose(DIRECTION, c("explain.move"))))

    # A driver moved.
    component_move = move_class(c("dominant_baseline"), c("dominant_incident"))
    chosen, second = c("chosen.label"), c("second.label")
    phrase = choose(EVIDENCE_PHRASE, c("chosen.evidence_mode"), lit(EVIDENCE_PHRASE["other"]))
    moved_finding = F.when(component_move == "unknown", fill(
        S["moved_alone"], driver=chosen, driver_moved=choose(DIRECTION, c("chosen.move")))).otherwise(fill(
            S["moved_finding"], driver=chosen, driver_moved=choose(DIRECTION, c("chosen.move")), component=component,
            component_moved=choose(DIRECTION, component_move)))
    differs = c("explain.driver") != c("chosen.driver")
    moved_why = F.concat(
        fill(S["moved_why"], component=component, kpi=kpi, phrase=phrase),
        F.when(c("chosen.align") == "aligned", S["why_aligned"]).otherwise(""),
        F.when(c("upstream").isNotNull(), fill(S["why_upstream"], upstream=c("upstream.label"), driver=chosen)).otherwise(""),
        F.when(differs, fill(S["why_explained"], explanation=c("explain.label"), component=component, driver=chosen))
        .otherwise(""))
    split = F.coalesce(c("chosen.weight") - c("second.weight") <= SPLIT_GAP + 1e-12, lit(False))
    weak = (c("chosen.evidence_mode") == HISTORICAL) & ~F.coalesce(c("chosen.is_significant"), lit(False))
    complex_mix = (c("narrative_mode") == "complex_interaction") | F.coalesce("is_volatile", lit(False))
    ambiguous = F.coalesce((F.lower("confidence_level") == "low") | weak | split | complex_mix, lit(False))
    through = F.coalesce((c("second.causal_role") == "upstream")
                         & (c("second.mediates_through") == c("chosen.driver")), lit(False))
    pair = dict(second=second, driver=chosen, component=component)
    second_check = F.when(c("second").isNull(), none).when(ambiguous, F.when(
        through, fill(S["parallel_upstream"], **pair)).otherwise(fill(S["parallel_peer"], **pair))).otherwise(F.when(
            through, fill(S["next_upstream"], **pair)).otherwise(fill(S["next_peer"], **pair)))
    step = dict(driver=chosen, check=c("chosen.next_check"), action=c("chosen.action_if_confirmed"))
    moved_advice = F.when(ambiguous & c("second").isNotNull(), fill(S["validate_split"], second_check=second_check, **step)) \
        .when(ambiguous, fill(S["validate_alone"], **step)) \
        .otherwise(F.concat_ws(" ", fill(S["act"], **step), second_check))

    def by(quality=none, monitor=none, nothing=none, unmoved=none, moved=none) -> Column:
        return (F.when(case == "data_quality_first", quality).when(case == "monitor", monitor)
                .when(case == "no_usable_driver", nothing).when(case == "validate_unexplained", unmoved).otherwise(moved))

    why_unmoved = fill(S["unexplained_why"], component=component, kpi=kpi)
    health_text = fill(S["health_finding"], sources=sources)
    monitor_text = fill(S["monitor_finding"], kpi=kpi)
    advice_unmoved = fill(S["unexplained_advice"], driver=c("explain.label"), reason=still,
                          check=c("explain.hidden_check"), action=lit(S["unexplained_action"]))
    yes, no = lit(True), lit(False)
    no_number, no_flag = lit(None).cast("double"), lit(None).cast("boolean")
    cols = {
        "action_level": by(lit("data_quality_first"), lit("monitor"), lit("validate"), lit("validate_unexplained"),
                           F.when(ambiguous, "validate").otherwise("act")),
        "primary_driver": by(unmoved=c("explain.driver"), moved=c("chosen.driver")),
        "primary_driver_label": by(unmoved=c("explain.label"), moved=chosen),
        "primary_component": by(nothing=c("dominant_component"), unmoved=c("dominant_component"), moved=c("dominant_component")),
        "primary_component_label": by(nothing=component, unmoved=component, moved=component),
        "owner": by(lit(DATA_OWNER), unmoved=c("explain.owner"), moved=c("chosen.owner")),
        "driver_direction": by(unmoved=c("explain.move"), moved=c("chosen.move")),
        "component_direction": by(unmoved=component_move, moved=component_move),
        "finding": by(health_text, monitor_text, gap_text("finding"), still, moved_finding),
        "why_it_matters": by(lit(S["health_why"]), lit(S["monitor_why"]), lit(S["no_driver_why"]), why_unmoved, moved_why),
        "next_check": by(health_check, lit(S["monitor_check"]), gap_text("check"), c("explain.hidden_check"),
                         c("chosen.next_check")),
        "action_if_confirmed": by(lit(S["health_action"]), lit(S["monitor_action"]), lit(S["no_driver_action"]),
                                  lit(S["unexplained_action"]), c("chosen.action_if_confirmed")),
        "why": by(health_text, monitor_text, gap_text("finding"), still, moved_why),
        "recommended_action": by(
            fill(S["health_advice"], check=health_check, action=lit(S["health_action"])), lit(S["monitor_advice"]),
            fill(S["no_driver_advice"], check=gap_text("check")), advice_unmoved, moved_advice),
        "secondary_driver": by(moved=c("second.driver")),
        "secondary_driver_label": by(moved=second),
        "secondary_check": by(moved=second_check),
        "is_ambiguous": by(yes, no, yes, yes, ambiguous),
        "movement_status": by(lit("data_quality_blocked"), lit("monitor"), lit("no_usable_driver"),
                              lit("no_material_driver_movement"), lit("material_movement")),
        "direction_alignment": by(*[lit("not_evaluated")] * 4, c("chosen.align")),
        "validation_reason": by(nothing=reason),
        "evidence_mode": by(unmoved=c("explain.evidence_mode"), moved=c("chosen.evidence_mode")),
        "best_lag_days": by(*[lit(None).cast("int")] * 3, c("explain.best_lag_days"), c("chosen.best_lag_days")),
        "driver_baseline_value": by(*[no_number] * 3, c("explain.baseline_value"), c("chosen.baseline_value")),
        "driver_incident_value": by(*[no_number] * 3, c("explain.incident_value"), c("chosen.incident_value")),
        "kpi_direction": by(moved=F.when(c("percent_change").isNull(), "changed").when(c("percent_change") > 0, "increased")
                            .when(c("percent_change") < 0, "decreased").otherwise("was broadly unchanged")),
        "evidence_confidence": by(lit("Low"), *[F.initcap("confidence_level")] * 4),
        "leading_explanation_driver": by(unmoved=c("explain.driver"), moved=c("explain.driver")),
        "leading_explanation_driver_label": by(unmoved=c("explain.label"), moved=c("explain.label")),
        "action_target_driver": by(moved=c("chosen.driver")),
        "action_target_driver_label": by(moved=chosen),
        "explanation_differs_from_action_target": by(*[no_flag] * 4, differs),
        "upstream_driver": by(moved=c("upstream.driver")),
        "upstream_driver_label": by(moved=c("upstream.label")),
        "mechanism_chain": by(moved=F.when(c("upstream").isNotNull(), fill(
            S["chain"], upstream=c("upstream.label"), driver=chosen, component=component))),
    }
    out = df.select(*INCIDENT, *[v.alias(k) for k, v in cols.items()])
    return out.withColumn("action_readiness", choose(READINESS, c("action_level"), lit("Validate first"))) \
              .select(*INCIDENT, *CONTEXT)


def base_readiness(action_level: Column) -> Column:
    out = F.lit(BASE_DEFAULT)
    for k, v in BASE_READINESS.items():
        out = F.when(F.lower(F.trim(action_level)) == k, v).otherwise(out)
    return out


def as_struct(context: DataFrame, name: str = "action_context") -> DataFrame:
    extra = [c for c in context.columns if c not in INCIDENT]
    return context.select(*INCIDENT, F.struct(*extra).alias(name))


__all__ = ["action_context", "alignment", "as_struct", "base_readiness", "candidates", "component_order", "move_class"]
