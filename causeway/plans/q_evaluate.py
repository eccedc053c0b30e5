"""Scores and audits. Truth is derived from the incidents by fixed offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.functions.table import one_row, same_rows
from causeway.operators import evaluate as Q
from causeway.operators.decision import dominant
from causeway.operators.lags import PAIR
from causeway.operators.series import INCIDENT
from causeway.plans import refresh as R
from causeway.plans.catalog import query, show
from causeway.plans.workspace import Workspace


def truth(w: Workspace) -> DataFrame:
    shift = F.dayofyear("window_start") % 7 - 3
    lead = dominant(w.impacts).select(*INCIDENT, F.col("dominant_component").alias("expected_component"))
    return w.incidents.join(lead, INCIDENT, "left").select(
        F.concat_ws("|", "kpi", "region", F.col("window_start").cast("string")).alias("scenario_id"), "kpi", "region",
        F.date_add("window_start", shift).alias("changepoint_date"), F.lit(2).alias("tolerance_days"), "expected_component",
        "window_start")


def ranks(w: Workspace) -> DataFrame:
    """Expected rank: drivers of the expected component by name."""
    rows = truth(w).join(w.drivers.select("kpi", F.col("component").alias("expected_component"), "driver"),
                         ["kpi", "expected_component"])
    return rows.select("scenario_id", "driver", F.row_number().over(
        W.partitionBy("scenario_id").orderBy(F.desc("driver"))).alias("rank"))


def lags(w: Workspace) -> DataFrame:
    return truth(w).join(w.drivers.select("kpi", F.col("component").alias("expected_component"), "driver", "max_lag"),
                         ["kpi", "expected_component"]).select(
        "scenario_id", "driver", F.floor(F.col("max_lag") / 2).cast("int").alias("days"), F.lit(2).alias("tolerance"),
        F.lit("daily").alias("cadence_label"), F.lit(True).alias("evaluate"))


@query
def changepoint_recall(w: Workspace) -> DataFrame:
    found = w.incidents.select("kpi", "region", F.col("window_start").alias("changepoint_date"))
    return show(Q.changepoint_recall(truth(w), found), "hits total", "recall")


@query
def closest_window(w: Workspace) -> DataFrame:
    return Q.closest_window(truth(w), w.evidence)


@query
def rank_cases(w: Workspace) -> DataFrame:
    return show(Q.rank_cases(truth(w), ranks(w), w.evidence), "scenario_id top1", "recall_at_2 reciprocal_rank spearman")


@query
def rank_metrics(w: Workspace) -> DataFrame:
    return show(Q.rank_metrics(truth(w), ranks(w), w.evidence), "eligible_cases covered_cases spearman_cases",
                "evidence_coverage top1_accuracy recall_at_2 mean_reciprocal_rank mean_spearman")


@query
def lag_metrics(w: Workspace) -> DataFrame:
    return show(Q.lag_metrics(Q.lag_cases(truth(w), lags(w), w.evidence, w.drivers)),
                "exact_eligible exact_covered exact_correct cadence_limited cadence_consistent",
                "exact_share mean_absolute_error median_absolute_error")


def outages(w: Workspace) -> DataFrame:
    return truth(w).select("scenario_id", "region", F.col("window_start").alias("intervention_date"),
                           F.explode(F.array(F.lit("sales"), F.lit("marketing"))).alias("source_name"))


@query
def health_recall(w: Workspace) -> DataFrame:
    return show(Q.health_recall(Q.health_cases(outages(w), w.health)), "eligible_cases",
                "source_detection_recall low_confidence_enforcement_rate")


@query
def isolation_audit(w: Workspace) -> DataFrame:
    """Fingerprints of the facts, taken while they were written and again after the retrieval steps have written."""
    stored = w.raw_prints
    w.supports  # noqa: B018  (the layer is written here)
    return Q.isolation(w.facts.market_context, stored, w.prints())


@query
def language_audit(w: Workspace) -> DataFrame:
    return one_row(w.final_actions.agg(F.count("*").alias("checked")),
                   Q.language_violations(w.final_actions, w.narration).agg(F.count("*").alias("failures")))


@query
def policy_audit(w: Workspace) -> DataFrame:
    bad = Q.policy_violations(w.actions, w.plans, w.contexts, w.retrieved)
    return one_row(w.plans.agg(F.count("*").alias("planned")), bad.agg(F.count("*").alias("failures")))


@query
def feedback_neutrality(w: Workspace) -> DataFrame:
    """Evidence and decomposition stored in refreshed bundles against the layers they came from."""
    parts = R.stored(R.refresh_feedback(w.bundles, w.feedback, w.cutoff))
    cols = [*PAIR, "best_lag_days", "evidence_score", "normalized_score", "softmax_probability", "is_significant"]
    evidence = same_rows(parts["evidence"].select(*cols), w.evidence.select(*cols))
    split = [*INCIDENT, "effect_a", "effect_b", "interaction_effect", "residual", "is_volatile"]
    return Q.neutrality(evidence, same_rows(R.without_totals(parts["packets"]).select(*split), w.decomposed.select(*split)),
                        w.final_calibration)
