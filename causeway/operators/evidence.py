"""Evidence per (incident, component, driver)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.functions import arrays as A
from causeway.operators.lags import GROUP, PAIR

# Scoring constants.
BASELINE_ROWS = 30
MAD_SCALE = 0.6745
FLAT = 1e-9
Z_SATURATION = 3.0
DEAD_BAND = 1e-6
CONTRADICTION_WEIGHT = 0.10
MEDIATED_WEIGHT = 0.60
WEAK_VALIDITY = 0.5
TEMPERATURE = 0.35
MIN_ROWS = 30
MIN_ROWS_PER_DRIVER = 10
MIN_USABLE = 12

STRUCTURAL = "structural_break"
HISTORICAL = "historical_relationship"
INSUFFICIENT = "insufficient_evidence"


def profiles(pairs: DataFrame) -> DataFrame:
    """One row per pair with its short ordered arrays (one window holds at most 109 days)."""
    def ordered(cond: Column, value: str) -> Column:
        cell = F.struct(F.col("metric_date").alias("d"), F.col(value).alias("v"))
        return F.sort_array(F.collect_list(F.when(cond & F.col(value).isNotNull(), cell)))
    history, incident = F.col("role") == "history", F.col("role") == "incident"
    context = F.col("metric_date") >= F.date_sub("window_start", F.col("context_days"))
    seen = F.when(history, F.col("x"))
    return pairs.groupBy(*PAIR, "ordinal", "cadence").agg(
        ordered(history, "x").alias("hist_x"), ordered(history, "y").alias("hist_y"),
        ordered(incident, "x").alias("inc_x"), ordered(incident, "y").alias("inc_y"),
        ordered(context, "x").alias("context_x"),
        F.sort_array(F.collect_list(F.when(history, F.struct(F.col("metric_date").alias("d"), "x", "y"))))
        .alias("history_rows"),
        F.collect_list(F.when(incident, F.col("metric_date"))).alias("targets"),
        F.count(F.when(history & F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("n_pairs"),
        F.count(seen).alias("n_x"), F.avg(seen).alias("mean_x"), F.median(seen).alias("median_x"),
        F.coalesce(F.stddev_pop(seen), F.lit(0.0)).alias("history_std"))


def value_of(cells: str | Column) -> Column:
    return F.transform(cells, lambda e: e["v"])


def aligned_incident(lag: Column) -> Column:
    """Driver values at t - lag for each incident day t; without context, the incident's own values."""
    moved = F.filter("context_x", lambda e: F.array_contains("targets", F.date_add(e["d"], lag)))
    return F.when(F.size("context_x") > 0, moved).otherwise(F.col("inc_x"))


def robust_z(level: Column, center: Column, mad: Column, average: Column, spread: Column) -> Column:
    """Median/MAD z-score of the incident mean, falling back to mean/std for a degenerate MAD."""
    z = F.when(mad >= FLAT, (level - center) / F.nullif(mad / MAD_SCALE, F.lit(0.0))) \
         .when(spread >= FLAT, (level - average) / F.nullif(spread, F.lit(0.0))).otherwise(0.0)
    return F.when(center.isNull() | level.isNull(), 0.0).otherwise(z)


def level_shift(before: Column, during: Column) -> Column:
    """|during - before| / (|during| + |before|), 0 when either is missing or they agree."""
    gap = F.abs(during - before)
    return F.when(before.isNull() | during.isNull() | (gap < FLAT), 0.0).otherwise(
        gap / (F.abs(before) + F.abs(during) + FLAT))


def movement(before: Column, after: Column) -> Column:
    size = F.greatest(F.abs(before), F.abs(after), F.lit(1.0))
    return F.when(F.abs(after - before) <= DEAD_BAND * size, 0).when(after > before, 1).otherwise(-1)


def direction_consistency(driver_move: Column, component_move: Column, correlation: Column, sign: Column) -> Column:
    """The declared sign decides; the historical correlation only fills in for an unknown one."""
    effect = (
        F.when(sign == "positive", 1).when(sign == "negative", -1)
        .when(correlation >= FLAT, 1).when(correlation <= -FLAT, -1).otherwise(0)
    )
    return (
        F.when((driver_move == 0) | (component_move == 0) | (effect == 0), "not_evaluated")
        .when(driver_move * effect == component_move, "aligned").otherwise("contradictory")
    )


def mechanism(drivers: DataFrame) -> DataFrame:
    """Discount an upstream driver when its mediator is measured for the same component."""
    mediators = drivers.select("kpi", "component", F.col("driver").alias("mediates_through"),
                               F.lit(True).alias("measured"))
    return (
        drivers.join(F.broadcast(mediators), ["kpi", "component", "mediates_through"], "left")
        .withColumn("mechanism_weight", F.when((F.col("causal_role") == "upstream") & F.col("measured"),
                                               MEDIATED_WEIGHT).otherwise(1.0))
        .select("kpi", "component", "driver", "causal_role", "mediates_through", "expected_effect_sign",
                "mechanism_weight")
    )


def signals(profile: DataFrame, lags: DataFrame, drivers: DataFrame) -> DataFrame:
    """Everything about a pair that needs no fitted model."""
    df = profile.join(lags, PAIR).join(F.broadcast(mechanism(drivers)), ["kpi", "component", "driver"])
    df = (
        df.withColumn("moved_x", value_of(aligned_incident(F.col("best_lag_days"))))
        .withColumn("mad_x", A.median(F.transform("hist_x", lambda e: F.abs(e["v"] - F.col("median_x")))))
        .withColumn("moved_mean", A.mean(F.col("moved_x")))
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    df = (
        df.withColumn("baseline_value", zero(A.mean(A.last(value_of("hist_x"), BASELINE_ROWS))))
        .withColumn("incident_value", zero(F.col("moved_mean")))
        .withColumn("component_baseline", zero(A.mean(A.last(value_of("hist_y"), BASELINE_ROWS))))
        .withColumn("component_incident", zero(A.mean(value_of("inc_y"))))
        .withColumn("zscore", robust_z(*[F.col(c) for c in ("moved_mean", "median_x", "mad_x", "mean_x", "history_std")]))
        .withColumn("shift_score", level_shift(F.col("mean_x"), F.col("moved_mean")))
    )
    return (
        df.withColumn("is_break", (F.col("n_x") > 0) & (F.col("history_std") < FLAT) & (F.col("shift_score") > FLAT))
        .withColumn("severity", F.least(F.lit(1.0), F.abs("zscore") / Z_SATURATION))
        .withColumn("direction", direction_consistency(
            movement(F.col("baseline_value"), F.col("incident_value")),
            movement(F.col("component_baseline"), F.col("component_incident")),
            F.col("historical_lag_correlation"), F.col("expected_effect_sign")))
    )


def required_rows(n_drivers: Column) -> Column:
    return F.greatest(F.lit(MIN_ROWS), MIN_ROWS_PER_DRIVER * F.greatest(n_drivers, F.lit(1)))


def complete_days(rows: str = "history_rows", lag: str = "best_lag_days") -> Column:
    """History days on which the component has a value, and the driver had one ``lag`` rows before."""
    there = lambda v: v.isNotNull() & ~F.isnan(v.cast("double"))
    return F.array_compact(F.transform(rows, lambda r, i: F.when(
        there(r["y"]) & there(F.get(F.col(rows), (i - F.col(lag)).cast("int"))["x"]), r["d"])))


def model_sufficiency(signal: DataFrame) -> DataFrame:
    """Sample-size gate per (incident, component) on the history days that are complete for all of its drivers at once.

    A component's day sets are few and short (a driver each, at most 90 days), so they meet in one array.
    """
    sets = signal.select(*GROUP, complete_days().alias("days")).groupBy(*GROUP).agg(
        F.collect_list("days").alias("sets"), F.count("*").alias("n_drivers"))
    both = F.aggregate("sets", F.get("sets", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return sets.select(*GROUP, "n_drivers", F.size(both).cast("bigint").alias("observed")) \
        .withColumn("required", required_rows(F.col("n_drivers"))) \
        .withColumn("model_status", F.when(F.col("observed") >= F.col("required"), "fitted")
                    .otherwise("insufficient_history"))


def correlation_model(signal: DataFrame, strong: float = 0.3) -> DataFrame:
    """A model table without regression: validity from |r|, for runs that skip the fitted model."""
    gate = model_sufficiency(signal).select(*GROUP, "model_status")
    r = F.col("historical_lag_correlation")
    return signal.join(gate, GROUP).select(
        *PAIR, "model_status", r.alias("historical_coefficient"), F.lit(None).cast("double").alias("holdout_r2"),
        F.lit(None).cast("double").alias("p_value"), (F.abs(r) >= strong).alias("is_significant"),
        F.lit(1.0).alias("coefficient_stability"))


def score(signal: DataFrame, model: DataFrame) -> DataFrame:
    """Evidence score under the three regimes: structural break, no fitted model, historical relationship."""
    df = signal.join(model, PAIR)
    is_break, fitted = F.col("is_break"), F.col("model_status") == "fitted"
    used = is_break | fitted
    weight = F.when(F.col("direction") == "contradictory", CONTRADICTION_WEIGHT).otherwise(1.0)
    history = (
        F.least(F.lit(1.0), F.abs("historical_lag_correlation")) * F.col("severity")
        * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("coefficient_stability")))
        * F.when(F.col("is_significant"), 1.0).otherwise(WEAK_VALIDITY)
    )
    regime = lambda a, b, c: F.when(is_break, a).when(fitted, b).otherwise(c)
    return df.select(
        *PAIR, "ordinal", "best_lag_days", "historical_lag_correlation", "baseline_value", "incident_value",
        F.col("cadence").alias("source_cadence_days"), F.col("cadence").alias("lag_resolution_days"),
        "causal_role", "mediates_through", "expected_effect_sign", "mechanism_weight",
        regime(F.lit(STRUCTURAL), F.lit(HISTORICAL), F.lit(INSUFFICIENT)).alias("evidence_mode"),
        F.when(is_break, "historical_variance_unavailable").otherwise(F.col("model_status")).alias("model_status"),
        F.when(is_break, 0.0).otherwise(F.col("zscore")).alias("driver_zscore"),
        F.when(is_break, F.col("shift_score")).otherwise(0.0).alias("structural_break_score"),
        regime(F.lit(0.0), F.col("historical_coefficient"), F.lit(0.0)).alias("historical_coefficient"),
        F.when(~is_break, F.col("holdout_r2")).alias("holdout_r2"),
        F.when(~is_break & fitted, F.col("p_value")).alias("p_value"),
        regime(F.lit(False), F.coalesce("is_significant", F.lit(False)), F.lit(False)).alias("is_significant"),
        regime(F.lit(0.0), F.col("coefficient_stability"), F.lit(0.0)).alias("coefficient_stability"),
        F.when(is_break, F.col("shift_score")).otherwise(F.col("severity")).alias("incident_severity_strength"),
        F.when(used, F.col("direction")).otherwise("not_evaluated").alias("direction_consistency"),
        (regime(F.col("shift_score"), history, F.lit(0.0)) * F.when(used, weight * F.col("mechanism_weight"))
         .otherwise(1.0)).alias("evidence_score"),
    )


def weights(scored: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Max-normalised score and stable softmax inside each (incident, component).

    All-zero scores give a uniform weight.
    """
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    w = W.partitionBy(*GROUP)
    raw = F.coalesce(F.when(~F.isnan("evidence_score"), F.col("evidence_score")), F.lit(0.0))
    top = F.max(raw).over(w)
    norm = F.when(top > 0, F.greatest(raw, F.lit(0.0)) / F.nullif(top, F.lit(0.0))).otherwise(0.0)
    df = scored.withColumn("normalized_score", norm)
    lifted = F.exp((F.col("normalized_score") - F.max("normalized_score").over(w)) / temperature)
    return df.withColumn("softmax_probability", lifted / F.sum(lifted).over(w))


def usable(mode: str = "evidence_mode", status: str = "model_status") -> Column:
    return (F.coalesce(mode, F.lit("")) != INSUFFICIENT) & ~F.coalesce(status, F.lit("")).startswith("insufficient")


def valid() -> Column:
    """A structural break counts as valid evidence."""
    return F.when(F.col("evidence_mode") == STRUCTURAL, True).otherwise(F.coalesce("is_significant", F.lit(False)))


def usable_series(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Enough finite observations with some variance."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n_observed"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("spread")
    ).withColumn("is_usable", (F.col("n_observed") >= MIN_USABLE) & (F.col("spread") > 1e-8)
                 & F.coalesce(F.abs("low") < float("inf"), F.lit(False))
                 & F.coalesce(F.abs("high") < float("inf"), F.lit(False)))
