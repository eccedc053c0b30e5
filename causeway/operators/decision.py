"""Decision packet: dominant component, ambiguity measures, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.operators.evidence import usable, valid
from causeway.operators.health import STALE_DAYS
from causeway.operators.series import INCIDENT

# Confidence thresholds and packet wording.
MIN_TOP_GAP = 0.10
MIN_TOP2_MASS = 0.55
STALE_CAVEAT = "Faulty or late feeds behind this result: %s. Confidence is therefore low."
GAP_CAVEAT = "The data behind this result is %d days old."


def component_order(impacts: DataFrame) -> DataFrame:
    """Components by absolute impact; contract order breaks ties."""
    size = F.round(F.abs(F.coalesce("impact", F.lit(0.0))), 9)
    return impacts.withColumn("component_rank", F.row_number().over(
        W.partitionBy(*INCIDENT).orderBy(size.desc(), "ordinal")))


def dominant(impacts: DataFrame) -> DataFrame:
    return component_order(impacts).filter("component_rank = 1").select(
        *INCIDENT, F.col("component").alias("dominant_component"),
        F.col("baseline").alias("dominant_baseline"), F.col("incident").alias("dominant_incident"))


def weight_order(weight: str | Column) -> Column:
    """Descending weight, stable to the last bits so that contract order decides real ties."""
    return F.round(F.col(weight) if isinstance(weight, str) else weight, 9).desc()


def driver_order(evidence: DataFrame, weight: str = "softmax_probability") -> DataFrame:
    """Rank drivers inside their component."""
    return evidence.withColumn("driver_rank", F.row_number().over(
        W.partitionBy(*INCIDENT, "component").orderBy(weight_order(weight), "ordinal")))


def relevant(evidence: DataFrame, lead: DataFrame) -> DataFrame:
    """Drivers of the dominant component, or all drivers when it has none."""
    rows = evidence.join(lead, INCIDENT)
    match = F.coalesce(F.col("component") == F.col("dominant_component"), F.lit(False))
    return (
        rows.withColumn("match", match)
        .withColumn("any_match", F.max("match").over(W.partitionBy(*INCIDENT)))
        .filter("match OR NOT any_match")
        .withColumn("evidence_component", F.when(F.col("any_match"), F.col("dominant_component")))
    )


def top_two(rows: DataFrame) -> DataFrame:
    """Mass and gap of the two leading weights, and whether anything is valid or usable."""
    ranked = rows.withColumn("rn", F.row_number().over(
        W.partitionBy(*INCIDENT).orderBy(weight_order("softmax_probability"), "ordinal")))
    p = lambda n: F.coalesce(F.max(F.when(F.col("rn") == n, F.col("softmax_probability"))), F.lit(0.0))
    return ranked.groupBy(*INCIDENT, "evidence_component").agg(
        (p(1) + p(2)).alias("top2_probability_mass"), (p(1) - p(2)).alias("top_probability_gap"),
        F.bool_or(valid()).alias("any_driver_significant"), F.bool_or(usable()).alias("model_sufficient"),
        F.bool_or((F.col("rn") == 1) & valid()).alias("top_driver_valid"))


def confidence() -> Column:
    """High, Medium or Low. Monitoring, no usable model, unhealthy or old data are always Low."""
    miss = lambda cond: F.when(cond, 1).otherwise(0)
    weak = (miss(F.col("top2_probability_mass") < MIN_TOP2_MASS) + miss(F.col("top_probability_gap") < MIN_TOP_GAP)
            + miss(~F.col("top_driver_valid")))
    blocked = ((F.col("decision_type") == "monitor") | ~F.col("model_sufficient") | ~F.col("healthy")
               | (F.col("freshness_gap_days") > STALE_DAYS))
    return F.when(blocked, "Low").when(weak == 0, "High").when(weak == 1, "Medium").otherwise("Low")


def packets(changes: DataFrame, impacts: DataFrame, evidence: DataFrame, health: DataFrame) -> DataFrame:
    """One decision packet per incident."""
    top = top_two(relevant(evidence, dominant(impacts)))
    df = changes.join(top, INCIDENT, "left").join(health, INCIDENT, "left")
    has_drivers = F.col("top2_probability_mass").isNotNull()
    fill = {"top2_probability_mass": 0.0, "top_probability_gap": 0.0, "any_driver_significant": False,
            "model_sufficient": False, "top_driver_valid": False, "healthy": False, "freshness_gap_days": 0}
    df = df.withColumn("decision_type", F.when(has_drivers & F.col("is_material"), "investigate").otherwise("monitor"))
    df = df.fillna(fill).withColumn("confidence_level", confidence())
    stale = F.coalesce("stale_sources", F.array().cast("array<string>"))
    return df.withColumn("freshness_caveat", F.when(
        F.size(stale) > 0, F.format_string(STALE_CAVEAT, F.array_join(stale, ", ")))
        .when(F.col("freshness_gap_days") > STALE_DAYS, F.format_string(GAP_CAVEAT, F.col("freshness_gap_days"))))
