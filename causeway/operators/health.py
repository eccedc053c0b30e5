"""Source health as of each incident."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.operators.series import INCIDENT

# Health thresholds.
STALE_DAYS = 3
MIN_COMPLETENESS = 95.0
FINE = ("healthy", "ok", "fresh")


def dependencies(drivers: DataFrame, sources: DataFrame) -> DataFrame:
    """(kpi, source_name): every raw source behind a KPI or one of its candidate drivers."""
    metrics = drivers.select("kpi", F.explode(F.array("kpi", "driver")).alias("metric"))
    return metrics.join(sources, "metric").select("kpi", "source_name").distinct()


def required_sources(incidents: DataFrame, depends: DataFrame) -> DataFrame:
    return incidents.select(*INCIDENT).join(F.broadcast(depends), "kpi").select(*INCIDENT, "source_name")


def health_as_of(required: DataFrame, health: DataFrame) -> DataFrame:
    """The latest health row on or before each incident, per required source.

    An as-of join in one ordered pass: health rows and incidents of a (region, source) are
    merged by date and each incident takes the last health row before it. Work is linear;
    a range join would compare every incident with the whole past of its region.
    """
    facts = F.struct("health_date", "expected_cadence_hours", "observed_lag_hours", "completeness_pct", "status")
    events = health.select("region", "source_name", F.col("health_date").alias("day"), F.lit(0).alias("kind"),
                           F.lit(None).cast("string").alias("kpi"), facts.alias("h"))
    asks = required.select("region", "source_name", F.col("window_start").alias("day"), F.lit(1).alias("kind"), "kpi",
                           F.lit(None).cast(events.schema["h"].dataType).alias("h"))
    past = W.partitionBy("region", "source_name").orderBy("day", "kind").rowsBetween(W.unboundedPreceding, 0)
    return (
        events.unionByName(asks).withColumn("h", F.last("h", ignorenulls=True).over(past)).filter("kind = 1")
        .select("kpi", "region", F.col("day").alias("window_start"), "source_name", "h.*")
    )


def graded(as_of: DataFrame) -> DataFrame:
    """Per source: observed, missing or unhealthy by status, lag or completeness."""
    lag, full = F.coalesce("observed_lag_hours", F.lit(0.0)), F.coalesce("completeness_pct", F.lit(0.0))
    bad = (~F.lower(F.trim(F.coalesce("status", F.lit("")))).isin(*FINE)
           | (lag > STALE_DAYS * 24) | (full < MIN_COMPLETENESS))
    seen = F.col("health_date").isNotNull()
    return as_of.select(*INCIDENT, "source_name", "health_date", lag.alias("lag_hours"), seen.alias("is_observed"),
                        (~seen).alias("is_missing"), (~seen | bad).alias("is_stale"))


def missing_sources(as_of: DataFrame) -> DataFrame:
    return as_of.filter(F.col("health_date").isNull()).select(*INCIDENT, "source_name")


def verdict(graded_sources: DataFrame) -> DataFrame:
    """One health verdict per incident; missing metadata fails closed."""
    names = lambda c: F.sort_array(F.collect_set(F.when(F.col(c), F.col("source_name"))))
    df = graded_sources.groupBy(*INCIDENT).agg(
        names("is_observed").alias("observed_sources"), names("is_missing").alias("missing_sources"),
        names("is_stale").alias("all_stale"), F.max(F.when(F.col("is_observed"), F.col("lag_hours"))).alias("max_lag"))
    none = F.size("observed_sources") == 0
    return df.select(
        *INCIDENT, "observed_sources", "missing_sources",
        F.when(none, F.array().cast("array<string>")).otherwise(F.col("all_stale")).alias("stale_sources"),
        (~none & (F.size("all_stale") == 0)).alias("healthy"),
        F.when(none, "source_health_unavailable").when(F.size("all_stale") == 0, "healthy_sources")
        .otherwise("stale_or_incomplete_source").alias("health_status"),
        F.when(none, STALE_DAYS + 1).otherwise(F.ceil(F.coalesce("max_lag", F.lit(0.0)) / 24)).cast("bigint")
        .alias("freshness_gap_days"))
