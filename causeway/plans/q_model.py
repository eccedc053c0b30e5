"""Queries over the detected changepoints and the fitted kernels."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.operators import evaluate as Q
from causeway.operators.series import INCIDENT
from causeway.plans.catalog import query, show
from causeway.plans.q_decision import joined
from causeway.plans.q_evaluate import truth
from causeway.plans.job import CHANGEPOINT, run
from causeway.plans.workspace import Workspace
from causeway.session import checkpoint_root
from causeway.sources.raw import store
from causeway.sources.tables import Tables

PAIR = "kpi region window_start component driver"


@query
def changepoints(w: Workspace) -> DataFrame:
    return show(w.changepoints, "kpi region changepoint_date method",
                "segment_mean_before segment_mean_after shift_magnitude", 4)


@query
def detected_recall(w: Workspace) -> DataFrame:
    """The detector's output against the scenarios of the yearly largest shifts."""
    return show(Q.changepoint_recall(truth(w), w.changepoints), "hits total", "recall")


@query
def detected_decomposition(w: Workspace) -> DataFrame:
    return show(w.detected.decomposed, "kpi region window_start decomposition_type is_material is_volatile",
                "total_change:4 effect_a:4 effect_b:4 interaction_effect:4 percent_change:5")


@query
def detected_health(w: Workspace) -> DataFrame:
    return w.detected.verdicts.select(*INCIDENT, *joined("observed_sources", "missing_sources", "stale_sources"), "healthy",
                                      "health_status", "freshness_gap_days")


@query
def stationarity(w: Workspace) -> DataFrame:
    return w.model.select(*PAIR.split(), "driver_differenced", "component_differenced")


@query
def unit_roots(w: Workspace) -> DataFrame:
    """The test of every driver, and of the component itself as driver ''."""
    return show(w.fitted.tests, f"{PAIR} n lag_order degenerate differenced", "statistic", 4)


@query
def component_model(w: Workspace) -> DataFrame:
    return show(w.model, f"{PAIR} model_status n_observations validity_method is_significant",
                "historical_coefficient holdout_r2 p_value coefficient_stability alpha", 5)


@query
def driver_evidence(w: Workspace) -> DataFrame:
    """Evidence of every detected changepoint, with the fitted model."""
    return show(w.detected.evidence, f"{PAIR} evidence_mode model_status direction_consistency is_significant "
                "best_lag_days", "evidence_score normalized_score softmax_probability", 5)


def scratch(w: Workspace) -> Tables:
    return Tables(w.spark, f"{checkpoint_root(w.spark)}/causeway/{w.spark.sparkContext.applicationId}/tables-{uuid.uuid4().hex}")


@query
def stored_run(w: Workspace) -> DataFrame:
    """The facts stored as raw tables, a run over these alone, and what it stored of the decomposition."""
    tables = scratch(w)
    store(tables, w.facts)
    run(tables)
    run(tables)  # a second run replaces, it does not add
    return show(tables.read("pvm_decomposition"), "kpi region window_start decomposition_type is_material is_volatile",
                "total_change:4 effect_a:4 effect_b:4 interaction_effect:4 percent_change:5")


@query
def stored_telemetry(w: Workspace) -> DataFrame:
    tables = scratch(w)
    store(tables, w.facts)
    run(tables)
    return tables.read("runtime_telemetry").groupBy("operation_name", "status").agg(F.count("*").alias("n"))


@query
def stored_changes(w: Workspace) -> DataFrame:
    """A stored table after an upsert of one KPI, an update of one region and a removal of another."""
    tables, name = scratch(w), "detected_changepoints"
    rows = w.incidents.select("kpi", "region", F.col("window_start").alias("changepoint_date"), F.lit("first").alias("method"))
    tables.upsert("analysis", name, rows, CHANGEPOINT)
    tables.upsert("analysis", name, rows.filter("kpi = 'revenue'").withColumn("method", F.lit("second")), CHANGEPOINT)
    tables.update("analysis", name, rows.filter("region = 'ASIA'").withColumn("method", F.lit("third")), CHANGEPOINT)
    tables.delete("analysis", name, F.col("region") == "EUROPE")
    tables.append("analysis", name, rows.filter("region = 'AFRICA'").withColumn("method", F.lit("log")))
    return tables.read(name).select(*CHANGEPOINT, "method")


def loaded(w: Workspace) -> Tables:
    """Orders as a CSV in which some dates and some prices are no dates and no prices, loaded."""
    tables, key = scratch(w), F.col("o_orderkey")
    folder = f"{tables.root}-csv"
    w.facts.table("orders").select(
        key, F.when(key % 11 == 0, "1999-02-30").otherwise(F.to_date("o_orderdate").cast("string")).alias("calendar_date"),
        F.when(key % 13 == 0, "n/a").when(key % 17 == 0, "NaN").when(key % 19 == 0, " ")
        .otherwise((key % 1000).cast("string")).alias("units"), F.col("o_orderstatus").alias("event_name")).write.options(
            header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    tables.load_csv("business_calendar", folder, T.StructType.fromDDL("o_orderkey long, units int, calendar_date date"))
    return tables


@query
def csv_loaded(w: Workspace) -> DataFrame:
    """The rows that fit, blank cells as null."""
    return loaded(w).read("business_calendar").select("o_orderkey", F.col("units").cast("bigint").alias("units"), "calendar_date")


@query
def csv_rejects(w: Workspace) -> DataFrame:
    """The rows that do not fit, as they stand in the file, with the reasons."""
    return loaded(w).read("load_rejects").select("table_name", "line", "reason")


@query
def bound_read(w: Workspace) -> DataFrame:
    """A stored table asked by bound values; only the folder of one KPI is read."""
    tables = scratch(w)
    tables.upsert("analysis", "detected_changepoints", w.incidents.select("kpi", "region", F.col("window_start").alias("changepoint_date")), CHANGEPOINT)
    return tables.ask("detected_changepoints", "SELECT kpi, region, changepoint_date FROM {rows} WHERE kpi = :kpi AND changepoint_date >= :since",
                      kpi="revenue", since=dt.date(1995, 1, 1))
