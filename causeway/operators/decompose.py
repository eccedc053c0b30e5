"""Exact split of a KPI change into component effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.series import INCIDENT
from causeway.sources.contracts import Contract

# Guards of the decomposition and of the materiality rule.
MIN_DENOMINATOR = 1e-6
RESIDUAL_SHARE = 0.01
RESIDUAL_FLOOR = 1e-9
MATERIAL_CHANGE = 0.02
ZERO_BASE = 1e-9

METHODS = ("shapley", "forward", "reference")


def operator_of(contracts: dict[str, Contract]) -> Column:
    out = F.lit(None).cast("string")
    for c in contracts.values():
        out = F.when(F.col("kpi") == c.kpi, c.operator).otherwise(out)
    return out


def sides(levels: DataFrame, contracts: dict[str, Contract]) -> DataFrame:
    """One row per incident with a0, a1, b0, b1; incidents lacking a window are left out (``window_status`` names them)."""
    pick = lambda i, c: F.max(F.when(F.col("ordinal") == i, F.col(c)))
    return (
        levels.filter("history_rows > 0 AND incident_rows > 0").groupBy(*INCIDENT).agg(
            pick(0, "baseline").alias("a0"), pick(0, "incident").alias("a1"),
            pick(1, "baseline").alias("b0"), pick(1, "incident").alias("b1"),
            pick(0, "component").alias("component_a"), pick(1, "component").alias("component_b"))
        .withColumn("decomposition_type", operator_of(contracts))
    )


def window_status(incidents: DataFrame, levels: DataFrame) -> DataFrame:
    """Every incident with the reason why it can or cannot be split: (kpi, region, window_start, status)."""
    rows = levels.groupBy(*INCIDENT).agg(F.min("history_rows").alias("h"), F.min("incident_rows").alias("i"))
    return incidents.select(*INCIDENT).join(rows, INCIDENT, "left").select(
        *INCIDENT, F.when(F.col("h").isNull(), "no_data").when(F.col("h") == 0, "no_history")
        .when(F.col("i") == 0, "no_incident_rows").otherwise("analysed").alias("status"))


def decompose(df: DataFrame, method: str = "shapley") -> DataFrame:
    """Add effects to rows with decomposition_type, a0, a1, b0, b1.

    For a ratio: 'shapley' averages each component's own effect over both orders,
    'forward' moves the numerator first, 'reference' averages a numerator effect with a
    denominator effect (sums are exact in all three).
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    a0, a1, b0, b1 = (F.col(c) for c in ("a0", "a1", "b0", "b1"))
    kind = F.col("decomposition_type")
    multiply, divide = kind == "multiply", kind == "divide"
    low0, low1 = F.abs(b0) < MIN_DENOMINATOR, F.abs(b1) < MIN_DENOMINATOR
    unstable = divide & (low0 | low1)
    q = lambda x, y: F.when(F.abs(y) >= MIN_DENOMINATOR, x / F.nullif(y, F.lit(0.0))).otherwise(0.0)
    forward_a, forward_b = q(a1 - a0, b0), q(a1, b1) - q(a1, b0)
    if method == "shapley":
        div_a = (forward_a + q(a1 - a0, b1)) / 2
        div_b = (forward_b + (q(a0, b1) - q(a0, b0))) / 2
    elif method == "forward":
        div_a, div_b = forward_a, forward_b
    else:
        div_a = (forward_a + (q(a0, b1) - q(a0, b0))) / 2
        div_b = (forward_b + q(a1 - a0, b1)) / 2
    out = (
        df.withColumn("total_change", F.when(multiply, a1 * b1 - a0 * b0).when(divide, q(a1, b1) - q(a0, b0))
                      .otherwise(a1 - a0))
        .withColumn("effect_a", F.when(multiply, (a1 - a0) * b0).when(unstable, 0.0).when(divide, div_a)
                    .otherwise(F.col("total_change")))
        .withColumn("effect_b", F.when(multiply, (b1 - b0) * a0).when(unstable, 0.0).when(divide, div_b)
                    .otherwise(0.0))
        .withColumn("interaction_effect", F.when(multiply, (a1 - a0) * (b1 - b0)).otherwise(0.0))
        .withColumn("residual", F.when(unstable, 0.0).otherwise(
            F.col("total_change") - (F.col("effect_a") + F.col("effect_b") + F.col("interaction_effect"))))
    )
    broken = F.abs("residual") > F.greatest(F.abs("total_change") * RESIDUAL_SHARE, F.lit(RESIDUAL_FLOOR))
    return (
        out.withColumn("is_volatile", F.coalesce(unstable | (broken & (multiply | divide)), F.lit(False)))
        .withColumn("narrative_mode", F.when(F.col("is_volatile"), "complex_interaction").otherwise("standard"))
    )


def relative_change(df: DataFrame) -> DataFrame:
    """Change relative to the KPI's level before the incident; NULL for a level near zero."""
    base = (
        F.when(F.col("decomposition_type") == "multiply", F.col("a0") * F.col("b0"))
        .when(F.col("decomposition_type") == "single", F.col("a0"))
        .when(F.abs("b0") >= ZERO_BASE, F.col("a0") / F.nullif(F.col("b0"), F.lit(0.0)))
    )
    return (
        df.withColumn("kpi_baseline", base)
        .withColumn("percent_change", F.when(F.abs("kpi_baseline") > ZERO_BASE,
                                             F.col("total_change") / F.nullif(F.col("kpi_baseline"), F.lit(0.0))))
        .withColumn("is_material", F.when(F.col("percent_change").isNotNull(),
                                          F.abs("percent_change") > MATERIAL_CHANGE)
                    .otherwise(F.abs("total_change") > ZERO_BASE))
    )


def component_impacts(df: DataFrame) -> DataFrame:
    """One row per incident and component with its own effect, level before and during."""
    part = lambda side, i: F.struct(
        F.col(f"component_{side}").alias("component"), F.lit(i).alias("ordinal"),
        F.col(f"effect_{side}").alias("impact"), F.col(f"{side}0").alias("baseline"),
        F.col(f"{side}1").alias("incident"))
    return (
        df.select(*INCIDENT, F.explode(F.array(part("a", 0), part("b", 1))).alias("c")).select(*INCIDENT, "c.*")
        .filter("component IS NOT NULL")
    )


def failed_sums(df: DataFrame) -> DataFrame:
    """Decompositions whose parts do not add up to the change."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    parts = zero("effect_a") + zero("effect_b") + zero("interaction_effect") + zero("residual")
    return df.withColumn("reconstructed", parts).filter(
        F.abs(F.col("reconstructed") - zero("total_change"))
        > F.greatest(F.abs(zero("total_change")) * RESIDUAL_SHARE, F.lit(1e-6)))
