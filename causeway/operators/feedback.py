"""Bounded feedback calibration, downstream of the evidence."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.action import base_readiness
from causeway.operators.series import INCIDENT

# Calibration constants and wording.
VALUE = {"helpful": 1.0, "unclear": 0.0, "not helpful": -1.0}
PRIOR = 5.0
BOUND = 0.10
OTHER_REGION = 0.50
REASON = {
    "applied": "Earlier ratings of this pattern move the readiness figure within its bound.",
    "no_target": "Without a leading driver there is no pattern to look ratings up by.",
    "no_rows": "Nobody has rated this pattern before the cut-off.",
    "no_valid": "Ratings of this pattern exist, but none holds a known verdict.",
}
GOVERNANCE = "Ratings change the readiness figure and nothing before it: weights, ranks, lags, splits and sources stay as computed."
PATTERN = ["kpi", "primary_driver", "action_level"]


def disposition() -> Column:
    return F.lower(F.trim(F.coalesce("disposition", F.lit(""))))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(disposition().isin(*VALUE))


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter(~disposition().isin(*VALUE))


def tallies(feedback: DataFrame, cutoff: dt.datetime, include_demo: bool = False) -> DataFrame:
    """Feedback strictly before the cut-off, summed per (pattern, region).

    Summing first keeps a pattern that holds most of the feedback to one row per region.
    """
    if cutoff.tzinfo is None:
        cutoff = cutoff.replace(tzinfo=dt.timezone.utc)
    rows = feedback.filter(F.col("created_at").cast("timestamp") < F.lit(cutoff))
    if not include_demo:
        rows = rows.filter(~F.coalesce("is_demo", F.lit(False)))
    value = F.element_at(F.create_map(*[F.lit(x) for kv in VALUE.items() for x in kv]), disposition())
    return rows.withColumn("v", value).groupBy(*PATTERN, "region").agg(
        F.count("*").alias("rows"), F.count("v").alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))


def calibration(decisions: DataFrame, feedback: DataFrame, cutoff: dt.datetime, include_demo: bool = False) -> DataFrame:
    """Signal per decision (incident with primary_driver and action_level).

    A row from the same region counts fully and from another region half, so a decision
    needs only the pattern total and its own region's share: two equi joins, no fan-out.
    """
    local = tallies(feedback, cutoff, include_demo)
    overall = local.groupBy(*PATTERN).agg(F.sum("rows").alias("all_rows"), F.sum("n").alias("all_n"),
                                          F.sum("total").alias("all_total"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    df = decisions.select(*INCIDENT, "primary_driver", "action_level").join(overall, PATTERN, "left") \
                  .join(local, [*PATTERN, "region"], "left")
    weight = OTHER_REGION * zero("all_n") + (1 - OTHER_REGION) * zero("n")
    signed = OTHER_REGION * zero("all_total") + (1 - OTHER_REGION) * zero("total")
    df = df.withColumn("applied", zero("all_n") > 0) \
           .withColumn("w", weight).withColumn("m", F.when(F.col("applied"), signed / F.nullif("w", F.lit(0.0))).otherwise(0.0))
    reliability = F.col("w") / (F.col("w") + PRIOR)
    adjustment = F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), BOUND * F.col("m") * reliability))
    base = base_readiness(F.col("action_level"))
    blank = F.coalesce(F.trim("primary_driver"), F.lit("")) == ""
    return df.select(
        *INCIDENT, "primary_driver", "action_level", "applied",
        zero("all_n").alias("sample_count"), zero("n").alias("same_region_count"),
        F.round("w", 6).alias("effective_sample_size"), F.round("m", 6).alias("weighted_mean"),
        F.when(F.col("applied"), F.round(reliability, 6)).otherwise(0.0).alias("reliability"),
        F.when(F.col("applied"), F.round(adjustment, 6)).otherwise(0.0).alias("adjustment"),
        F.when(blank, REASON["no_target"]).when(F.col("applied"), REASON["applied"])
        .when(zero("all_rows") > 0, REASON["no_valid"]).otherwise(REASON["no_rows"]).alias("reason"),
        F.round(base, 6).alias("base_readiness_score"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + F.when(F.col("applied"), F.round(adjustment, 6))
                                               .otherwise(0.0))), 6).alias("adjusted_readiness_score"),
        F.lit(cutoff.isoformat(timespec="seconds")).alias("analysis_cutoff"),
        F.lit(include_demo).alias("demo_feedback_included"), F.lit(GOVERNANCE).alias("governance"))


def attach(actions: DataFrame, signal: DataFrame) -> DataFrame:
    """Add the calibration to an action context struct; nothing else in it changes."""
    extra = [c for c in signal.columns if c not in (*INCIDENT, "primary_driver", "action_level")]
    packed = signal.select(*INCIDENT, F.struct(
        F.col("kpi"), F.col("region"), F.col("window_start").cast("string").alias("window_start"),
        F.col("primary_driver").alias("matched_primary_driver"), F.col("action_level").alias("matched_action_level"),
        *extra).alias("cal"))
    return actions.join(packed, INCIDENT, "left").withColumn(
        "action_context", F.col("action_context").withField("feedback_calibration", F.col("cal"))).drop("cal")
