"""Read-side views over the stored layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.functions.wording import choose, friendly
from causeway.operators.decision import weight_order
from causeway.operators.series import INCIDENT
from causeway.sources.contracts import Contract

SERIES = ["kpi", "region"]
# Labels shown to users.
EVIDENCE_LABEL = {"historical_relationship": "Historical pattern", "structural_break": "New structural shift",
                  "insufficient_evidence": "Not enough evidence"}
STATUS_LABEL = {"fitted": "Model fitted", "insufficient_history": "Not enough history",
                "historical_variance_unavailable": "No useful historical variation"}
READY, WAITING, STABLE = "ready", "changepoint found, evidence not yet computed", "no changepoint detected"


def coverage(mart: DataFrame, contracts: dict[str, Contract], changepoints: DataFrame, packets: DataFrame) -> DataFrame:
    """One row per declared KPI and region with its counts and status."""
    kpis = F.explode(F.array(*[F.lit(k) for k in sorted(contracts)]))
    grid = mart.select("region").distinct().select(kpis.alias("kpi"), "region")
    n_cp = changepoints.groupBy(*SERIES).agg(F.count("*").alias("changepoints_detected"))
    n_pk = packets.groupBy(*SERIES).agg(F.count("*").alias("decision_packets"))
    df = grid.join(n_cp, SERIES, "left").join(n_pk, SERIES, "left").fillna(0)
    return df.withColumn("status", F.when(F.col("decision_packets") > 0, READY)
                         .when(F.col("changepoints_detected") > 0, WAITING).otherwise(STABLE))


def latest(df: DataFrame, keys: list[str] = SERIES, day: str = "window_start") -> DataFrame:
    """Rows of the latest window of each key."""
    newest = df.groupBy(*keys).agg(F.max(day).alias(day))
    return df.join(newest, [*keys, day], "left_semi")


def top_evidence(evidence: DataFrame, actions: DataFrame) -> DataFrame:
    """The leading driver of the latest incident: the action's explanation, else the largest weight."""
    named = actions.select(*INCIDENT, F.coalesce("leading_explanation_driver", "primary_driver").alias("named"),
                           "primary_component")
    rows = latest(evidence).join(named, INCIDENT, "left")
    match = F.coalesce(F.col("driver") == F.col("named"), F.lit(False)).cast("int")
    home = match * F.coalesce(F.col("component") == F.col("primary_component"), F.lit(False)).cast("int")
    rank = F.row_number().over(W.partitionBy(*SERIES).orderBy(
        home.desc(), match.desc(), weight_order("softmax_probability"), "ordinal"))
    return rows.withColumn("rn", rank).filter("rn = 1").select(*SERIES, "driver")


def kpi_summary(covered: DataFrame, packets: DataFrame, evidence: DataFrame, actions: DataFrame) -> DataFrame:
    """The card of every KPI and region."""
    now = latest(packets).select(*SERIES, "window_start", "percent_change", "confidence_level", "freshness_caveat") \
        .join(actions.select(*INCIDENT, "recommended_action"), INCIDENT, "left")
    df = covered.join(now, SERIES, "left").join(top_evidence(evidence, actions), SERIES, "left")
    noted = F.coalesce(F.trim("freshness_caveat"), F.lit("")) != ""
    no_packet, pct = F.col("window_start").isNull(), F.col("percent_change")
    stable, waiting = F.col("status") == STABLE, F.col("status") == WAITING

    def card(a: str, b: str, c: str, d: Column) -> Column:
        return F.when(no_packet & stable, a).when(no_packet & waiting, b).when(no_packet, c).otherwise(d)
    return df.select(
        *SERIES,
        card("Stable — no structural incident", "Analysis in progress", "No decision available",
             F.when((F.col("confidence_level") == "Low") | noted, "Needs validation").otherwise("Investigation available"))
        .alias("card_status"),
        card("No incident", "Shift detected", "—", F.when(pct.isNull(), "Baseline near zero")
             .otherwise(F.format_string("%+.1f%%", pct * 100))).alias("change"),
        card("Not required", "Pending", "—", F.initcap("confidence_level")).alias("confidence"),
        F.when(no_packet, "—").otherwise(F.col("window_start").cast("string")).alias("incident_date"),
        F.when(no_packet, "—").otherwise(F.coalesce(friendly("driver"), F.lit("—"))).alias("top_driver"),
        card("Nothing to explain: the level of this KPI has held.",
             "The level has moved; its drivers are still to be scored.",
             "This KPI has not been assessed.",
             F.coalesce("recommended_action", F.lit("No advice is stored with this decision."))).alias("recommendation"))


def counters(cards: DataFrame) -> DataFrame:
    """How many cards per region are active, stable, low in confidence or pending."""
    s = F.col("card_status")
    return cards.groupBy("region").agg(
        F.count_if(s.isin("Investigation available", "Needs validation")).alias("active"),
        F.count_if(s.startswith("Stable")).alias("stable"),
        F.count_if(F.lower("confidence") == "low").alias("low_confidence"),
        F.count_if(s.isin("Analysis in progress", "No decision available")).alias("pending"))


def lead_time(lag: Column, cadence: Column) -> Column:
    periods = (lag / cadence).cast("int")
    return F.when(lag.isNull(), "—").when(cadence > 1, F.concat(
        periods.cast("string"), F.lit(" source period"), F.when(periods == 1, "").otherwise("s"),
        F.format_string(" (~%d days; %d-day resolution)", lag, cadence))).otherwise(F.format_string("%d days", lag))


def business_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence of the latest incident in user wording."""
    return latest(evidence).select(
        *INCIDENT, friendly("driver").alias("possible_driver"), friendly("component").alias("what_it_can_explain"),
        choose(EVIDENCE_LABEL, F.col("evidence_mode"), friendly("evidence_mode")).alias("evidence_type"),
        lead_time(F.col("best_lag_days"), F.col("source_cadence_days")).alias("historical_lead_time"),
        F.col("baseline_value").alias("typical_historical_level"), F.col("incident_value").alias("incident_level"),
        (F.col("softmax_probability") * 100).alias("relative_evidence_weight_pct"),
        F.col("is_significant").alias("statistical_check_passed"),
        choose(STATUS_LABEL, F.col("model_status"), friendly("model_status")).alias("evidence_availability"))


def weight_shift(fused: DataFrame) -> DataFrame:
    """Weights before and after external evidence, latest incident."""
    return latest(fused).select(*INCIDENT, "component", "driver", F.col("softmax_probability").alias("probability_before"),
                                F.col("fused_probability").alias("probability_after"))


def latest_fused(evidence: DataFrame, updates: DataFrame) -> DataFrame:
    """Attach the most recent fused weight of each driver, else its own weight."""
    keys = [*INCIDENT, "driver"]
    newest = updates.filter(F.col("probability_after").isNotNull()).groupBy(*keys).agg(
        F.max_by("probability_after", "updated_at").alias("recent"))
    base = F.col("fused_probability") if "fused_probability" in evidence.columns else F.col("softmax_probability")
    return evidence.join(newest, keys, "left").withColumn(
        "fused_probability", F.coalesce("recent", base, "softmax_probability")).drop("recent")


def enrich(evidence: DataFrame, drivers: DataFrame) -> DataFrame:
    """Fill contract semantics that older evidence rows lack; stored values stay."""
    spec = {"source_cadence_days": "cadence", "lag_resolution_days": "cadence", "causal_role": "causal_role",
            "mediates_through": "mediates_through", "expected_effect_sign": "expected_effect_sign"}
    dim = drivers.select("kpi", "component", "driver", *[F.col(v).alias(f"c_{k}") for k, v in spec.items()])
    df = evidence.join(F.broadcast(dim), ["kpi", "component", "driver"], "left")
    for k in spec:
        df = df.withColumn(k, F.coalesce(F.col(k), F.col(f"c_{k}")) if k in evidence.columns else F.col(f"c_{k}"))
    return df.drop(*[f"c_{k}" for k in spec])


def dashboard(frames: dict[str, DataFrame], kpi: str, region: str) -> dict[str, DataFrame]:
    """The stored frames of one KPI and region, by date."""
    day = lambda df: "window_start" if "window_start" in df.columns else "changepoint_date"
    return {name: df.filter((F.col("kpi") == kpi) & (F.col("region") == region)).orderBy(day(df))
            for name, df in frames.items()}


def artifact_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Stored records per KPI, region and artifact."""
    out = None
    for name, df in frames.items():
        one = df.groupBy(*SERIES).agg(F.count("*").alias("records")).withColumn("artifact", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def decision_cases(bundles: DataFrame) -> DataFrame:
    """Decisions that can receive feedback, newest first."""
    act = "bundle.decision.action_context"
    return bundles.select(*INCIDENT, F.col(f"{act}.primary_driver").alias("primary_driver"),
                          F.col(f"{act}.action_level").alias("action_level")) \
        .filter("coalesce(primary_driver, '') <> '' AND coalesce(action_level, '') <> ''") \
        .orderBy(F.desc("window_start"), "kpi", "region")


def calibration_cards(bundles: DataFrame) -> DataFrame:
    """Feedback figures of the latest decision of each KPI and region."""
    c = "bundle.decision.action_context.feedback_calibration"
    return latest(bundles).select(*INCIDENT, F.col(f"{c}.sample_count").alias("sample_count"),
                                  F.col(f"{c}.adjustment").alias("adjustment"),
                                  F.col(f"{c}.adjusted_readiness_score").alias("adjusted_readiness_score"))
