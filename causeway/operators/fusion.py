"""Assessments of retrieved sources and their bounded effect on weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.operators.series import INCIDENT

# Bounds of support, confidence and influence.
SUPPORT = (-0.5, 1.0)
CONFIDENCE = (0.0, 1.0)
INFLUENCE = 0.25
NOTHING = 1e-12
MISSING = "assessment missing from model output"


def clamp(c: Column, bounds: tuple[float, float]) -> Column:
    safe = F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))
    return F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), safe))


def clean_assessments(raw: DataFrame, sources: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Known source and hypothesis only, bounded values, the last of repeated rows.

    ``raw``: incident, source_index, hypothesis, support, confidence, reason, seq.
    """
    known = raw.withColumn("hypothesis", F.trim("hypothesis")) \
        .join(sources.select(*INCIDENT, "source_index"), [*INCIDENT, "source_index"], "left_semi") \
        .join(hypotheses.select(*INCIDENT, "hypothesis"), [*INCIDENT, "hypothesis"], "left_semi")
    latest = known.groupBy(*INCIDENT, "source_index", "hypothesis").agg(
        F.max(F.struct("seq", "support", "confidence", "reason")).alias("r"))
    return latest.select(
        *INCIDENT, "source_index", "hypothesis",
        clamp(F.col("r.support").cast("double"), SUPPORT).alias("support"),
        clamp(F.col("r.confidence").cast("double"), CONFIDENCE).alias("confidence"),
        F.trim(F.coalesce("r.reason", F.lit(""))).alias("reason"))


def complete(clean: DataFrame, sources: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Every source of an incident with each of its hypotheses; an absent pair is zero evidence.

    An incident has at most five sources and two hypotheses.
    """
    pairs = sources.select(*INCIDENT, "source_index").join(hypotheses.select(*INCIDENT, "hypothesis"), INCIDENT)
    return pairs.join(clean, [*INCIDENT, "source_index", "hypothesis"], "left").fillna(
        {"support": 0.0, "confidence": 0.0, "reason": MISSING})


def support(assessments: DataFrame) -> DataFrame:
    """Confidence-weighted support per (incident, hypothesis), scaled by corroboration."""
    sure = F.sum("confidence")
    mean = F.when(sure > NOTHING, F.sum(F.col("support") * F.col("confidence")) / F.nullif(sure, F.lit(0.0))).otherwise(0.0)
    enough = F.greatest(F.lit(1), F.least(F.lit(2), F.count("*")))
    return assessments.groupBy(*INCIDENT, "hypothesis").agg(
        mean.alias("mean"), F.least(F.lit(1.0), sure / enough).alias("trust"), F.count("*").alias("n_sources_scored")
    ).select(*INCIDENT, "hypothesis", clamp(F.col("mean"), SUPPORT).alias("weighted_support"),
             clamp(F.col("trust"), CONFIDENCE).alias("retrieval_confidence"),
             clamp(F.col("mean") * F.col("trust"), SUPPORT).alias("effective_support"), "n_sources_scored")


def one_hypothesis(supported: DataFrame, hypothesis: str) -> DataFrame:
    """Support and confidence of a single hypothesis."""
    return supported.filter(F.col("hypothesis") == hypothesis).select(
        *INCIDENT, F.col("effective_support").alias("support"), F.col("retrieval_confidence").alias("confidence"))


def fuse(evidence: DataFrame, supports: DataFrame, influence: float = INFLUENCE) -> DataFrame:
    """Redistribute weight among the assessed drivers of an incident; all others stay as they are.

    ``supports``: incident, component, driver, effective_support. The assessed total is kept,
    and no support or zero support changes nothing.
    """
    if not 0 < influence <= INFLUENCE:
        raise ValueError(f"influence must be in (0, {INFLUENCE}]")
    keys = [*INCIDENT, "component", "driver"]
    df = evidence.join(supports.select(*keys, "effective_support"), keys, "left")
    before = F.greatest(F.lit(0.0), F.coalesce("softmax_probability", F.lit(0.0)))
    assessed = F.abs(F.coalesce("effective_support", F.lit(0.0))) > NOTHING
    moved = F.when(assessed, F.greatest(F.lit(0.0), before * (1 + influence * clamp(F.col("effective_support"), SUPPORT))))
    w = W.partitionBy(*INCIDENT)
    mass, raw_mass = F.sum(F.when(assessed, before)).over(w), F.sum(moved).over(w)
    return df.withColumn("fused_probability", F.when(
        assessed & (mass > 0) & (raw_mass > 0), moved * mass / F.nullif(raw_mass, F.lit(0.0))).otherwise(before)) \
        .withColumn("retrieval_support", F.coalesce("effective_support", F.lit(0.0))).drop("effective_support")


def best_per_driver(evidence: DataFrame) -> DataFrame:
    """The strongest weight of each driver name of an incident, whatever its component."""
    return evidence.filter("softmax_probability >= 0").groupBy(*INCIDENT, "driver").agg(
        F.max("softmax_probability").alias("probability"))


def stage_status(gates: DataFrame, plans: DataFrame, supported: DataFrame, evidence: DataFrame) -> DataFrame:
    """How far the external check of an incident went."""
    effect = supported.groupBy(*INCIDENT).agg(F.max(F.abs("effective_support")).alias("effect"))
    known = evidence.groupBy(*INCIDENT).agg(F.count("softmax_probability").alias("n"))
    df = gates.join(plans.select(*INCIDENT, "retrieval_target", "retrieval_query"), INCIDENT, "left") \
              .join(effect, INCIDENT, "left").join(known, INCIDENT, "left")
    return df.withColumn("status", F.when(~F.col("clarification_needed"), "deterministic_only")
                         .when(F.col("retrieval_target") == "internal", "clarification_internal")
                         .when((F.col("retrieval_target") != "web") | F.col("retrieval_query").isNull(),
                               "clarification_abstained")
                         .when(F.coalesce("n", F.lit(0)) == 0, "ambiguous_no_deterministic_probabilities")
                         .when(F.coalesce("effect", F.lit(0.0)) > NOTHING, "retrieval_fused")
                         .otherwise("retrieval_no_effective_support")) \
             .select(*INCIDENT, "clarification_needed", "status")
