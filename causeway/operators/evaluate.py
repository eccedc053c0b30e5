"""Scores against a truth table and audits of stored results.

Truth tables: ``truth`` (scenario_id, kpi, region, changepoint_date, tolerance_days,
expected_component), ``ranks`` (scenario_id, driver, rank), ``lags`` (scenario_id, driver,
days, tolerance, cadence_label, evaluate), ``outages`` (scenario_id, region,
intervention_date, source_name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.functions.arrays import pearson
from causeway.functions.wording import JARGON, mentions
from causeway.operators import external as X
from causeway.operators.decision import weight_order
from causeway.operators.evidence import usable
from causeway.functions.table import one_row
from causeway.operators.health import graded, health_as_of, verdict
from causeway.operators.series import INCIDENT

TOLERANCE = 2


def changepoint_hits(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """Per scenario whether a detection lies within its tolerance.

    The few admissible days of a scenario are listed, so the match is an equi join.
    """
    tol = F.coalesce("tolerance_days", F.lit(TOLERANCE))
    days = truth.filter(F.col("changepoint_date").isNotNull()).select(
        "scenario_id", "kpi", "region", F.explode(F.sequence(
            F.date_sub("changepoint_date", tol), F.date_add("changepoint_date", tol))).alias("day"))
    found = days.join(detected.select("kpi", "region", F.col("changepoint_date").alias("day")).distinct(),
                      ["kpi", "region", "day"], "left_semi").select("scenario_id").distinct()
    return truth.filter(F.col("changepoint_date").isNotNull()).select("scenario_id").join(
        found.withColumn("hit", F.lit(True)), "scenario_id", "left").fillna({"hit": False})


def changepoint_recall(truth: DataFrame, detected: DataFrame) -> DataFrame:
    return changepoint_hits(truth, detected).agg(
        F.count_if("hit").alias("hits"), F.count("*").alias("total"),
        (F.count_if("hit") / F.nullif(F.count("*"), F.lit(0))).alias("recall"))


def closest_window(truth: DataFrame, evidence: DataFrame) -> DataFrame:
    """The incident nearest to each scenario's date; the earlier one on a tie."""
    windows = evidence.select(*INCIDENT).distinct().select("kpi", "region", F.col("window_start").alias("day"), "window_start")
    asked = truth.select("kpi", "region", F.col("changepoint_date").alias("day"), "scenario_id")
    rows = windows.unionByName(asked, allowMissingColumns=True)
    series = W.partitionBy("kpi", "region").orderBy("day")
    before = F.max("window_start").over(series.rangeBetween(W.unboundedPreceding, W.currentRow))
    after = F.min("window_start").over(series.rangeBetween(W.currentRow, W.unboundedFollowing))
    near = rows.withColumn("before", before).withColumn("after", after).filter(F.col("scenario_id").isNotNull())
    earlier = F.col("after").isNull() | (F.datediff("day", "before") <= F.datediff("after", "day"))
    return near.select("scenario_id", "kpi", "region", F.when(earlier, F.coalesce("before", "after")).otherwise(F.col("after")).alias("window_start")) \
        .filter("window_start IS NOT NULL")


def case_evidence(truth: DataFrame, evidence: DataFrame) -> DataFrame:
    rows = closest_window(truth, evidence).join(evidence, INCIDENT)
    home = truth.select("scenario_id", "expected_component")
    return rows.join(home, "scenario_id").filter(
        F.col("expected_component").isNull() | (F.col("component") == F.col("expected_component")))


def driver_ranks(truth: DataFrame, ranks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Observed positions of usable drivers, one per scenario and driver name."""
    rows = case_evidence(truth, evidence).filter(usable()).join(ranks.select("scenario_id").distinct(),
                                                                "scenario_id", "left_semi")
    best = rows.groupBy("scenario_id", "driver").agg(
        F.max("softmax_probability").alias("weight"), F.min("ordinal").alias("ordinal"))
    place = W.partitionBy("scenario_id").orderBy(weight_order("weight"), "ordinal", "driver")
    tie = W.partitionBy("scenario_id").orderBy(weight_order("weight"))
    same = F.count("*").over(W.partitionBy("scenario_id", F.round("weight", 9)))
    return best.withColumn("position", F.row_number().over(place)) \
               .withColumn("average_rank", F.rank().over(tie) + (same - 1) / 2.0)


def rank_cases(truth: DataFrame, ranks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Top-1, recall at 2, reciprocal rank and rank correlation per covered scenario."""
    observed = driver_ranks(truth, ranks, evidence)
    lowest = F.min("rank").over(W.partitionBy("scenario_id"))
    both = observed.join(ranks.withColumn("lowest", lowest), ["scenario_id", "driver"], "full")
    r = F.col("rank")
    common = F.col("position").isNotNull() & r.isNotNull()
    return both.groupBy("scenario_id").agg(
        F.count("position").alias("n_observed"),
        F.coalesce(F.bool_or((F.col("position") == 1) & (r == F.col("lowest"))), F.lit(False)).alias("top1"),
        (F.count_if((r <= 2) & (F.col("position") <= 2)) / F.nullif(F.count_if(r <= 2), F.lit(0))).alias("recall_at_2"),
        F.coalesce(F.lit(1.0) / F.min(F.when(common, F.col("position"))), F.lit(0.0)).alias("reciprocal_rank"),
        F.count_if(common).alias("n_common"), F.min(F.when(common, r)).alias("r0"), F.max(F.when(common, r)).alias("r1"),
        F.min(F.when(common, F.col("average_rank"))).alias("a0"), F.max(F.when(common, F.col("average_rank"))).alias("a1"),
        pearson(F.when(common, r.cast("double")), F.when(common, F.col("average_rank"))).alias("c"),
    ).filter("n_observed > 0").withColumn("spearman", F.when(
        (F.col("n_common") >= 2) & (F.col("r0") < F.col("r1")) & (F.col("a0") < F.col("a1")), F.col("c"))) \
        .select("scenario_id", "top1", "recall_at_2", "reciprocal_rank", "spearman")


def rank_metrics(truth: DataFrame, ranks: DataFrame, evidence: DataFrame) -> DataFrame:
    cases = rank_cases(truth, ranks, evidence)
    eligible = ranks.select("scenario_id").distinct()
    return eligible.join(cases, "scenario_id", "left").agg(
        F.count("*").alias("eligible_cases"), F.count("top1").alias("covered_cases"),
        (F.count("top1") / F.nullif(F.count("*"), F.lit(0))).alias("evidence_coverage"),
        F.avg(F.col("top1").cast("double")).alias("top1_accuracy"), F.avg("recall_at_2").alias("recall_at_2"),
        F.avg("reciprocal_rank").alias("mean_reciprocal_rank"), F.avg("spearman").alias("mean_spearman"),
        F.count("spearman").alias("spearman_cases"))


def lag_cases(truth: DataFrame, lags: DataFrame, evidence: DataFrame, drivers: DataFrame) -> DataFrame:
    """Observed lag and error per scenario and driver; coarse sources are judged at their own cadence."""
    specs = drivers.groupBy("kpi", "driver").agg(F.min(F.struct("ordinal", "cadence")).alias("s")).select(
        "kpi", "driver", F.col("s.cadence").alias("contract_cadence"))
    label = F.lower(F.coalesce("cadence_label", F.lit("daily")))
    cadence = F.greatest(F.coalesce("contract_cadence", F.lit(1)),
                         F.when(label.isin("weekly", "week"), 7).otherwise(1))
    seen = case_evidence(truth, evidence).filter(usable()).groupBy("scenario_id", "driver").agg(
        F.max_by("best_lag_days", F.struct(F.round("evidence_score", 9), -F.col("ordinal"))).alias("observed_lag"))
    df = lags.filter(F.coalesce("evaluate", F.lit(True))).join(truth.select("scenario_id", "kpi"), "scenario_id") \
        .join(F.broadcast(specs), ["kpi", "driver"], "left").withColumn("cadence_days", cadence) \
        .join(seen, ["scenario_id", "driver"], "left")
    tol = F.coalesce("tolerance", F.lit(TOLERANCE))
    error = F.abs(F.col("observed_lag") - F.col("days"))
    return df.select("scenario_id", "driver", "cadence_days", (F.col("cadence_days") == 1).alias("is_exact"),
                     F.col("observed_lag").isNotNull().alias("found"), error.alias("error_days"),
                     (error <= F.when(F.col("cadence_days") > 1, F.greatest("cadence_days", tol)).otherwise(tol))
                     .alias("is_consistent"))


def lag_metrics(cases: DataFrame) -> DataFrame:
    exact, coarse, found = F.col("is_exact"), ~F.col("is_exact"), F.col("found")
    n = lambda c: F.count_if(c)
    err = F.when(exact & found, F.col("error_days").cast("double"))
    return cases.agg(
        n(exact).alias("exact_eligible"), n(exact & found).alias("exact_covered"),
        n(exact & found & F.col("is_consistent")).alias("exact_correct"),
        (n(exact & found & F.col("is_consistent")) / F.nullif(n(exact & found), F.lit(0))).alias("exact_share"),
        F.avg(err).alias("mean_absolute_error"), F.median(err).alias("median_absolute_error"),
        n(coarse).alias("cadence_limited"), n(coarse & found & F.col("is_consistent")).alias("cadence_consistent"))


def health_cases(outages: DataFrame, health: DataFrame) -> DataFrame:
    """Whether each declared outage is seen as of its date and forces Low confidence."""
    asked = outages.select(F.col("scenario_id").alias("kpi"), "region", F.col("intervention_date").alias("window_start"),
                           "source_name")
    seen = verdict(graded(health_as_of(asked, health)))
    want = asked.groupBy(*INCIDENT).agg(F.collect_set("source_name").alias("expected"))
    return want.join(seen, INCIDENT).select(
        F.col("kpi").alias("scenario_id"), "health_status",
        (~F.col("healthy") & (F.size(F.array_except("expected", "stale_sources")) == 0)).alias("detected"),
        (~F.col("healthy") | (F.col("freshness_gap_days") > 3)).alias("low_confidence_enforced"))


def health_recall(cases: DataFrame) -> DataFrame:
    share = lambda c: (F.count_if(c) / F.nullif(F.count("*"), F.lit(0)))
    return cases.agg(F.count("*").alias("eligible_cases"), share("detected").alias("source_detection_recall"),
                     share("low_confidence_enforced").alias("low_confidence_enforcement_rate"))


def isolation(context: DataFrame, stored: DataFrame, now: DataFrame) -> DataFrame:
    """Retrieval rows found in the raw context, and whether the raw tables still have the stored fingerprints.

    ``stored`` and ``now``: (table_name, row_count, content_sum).
    """
    dirty = context.agg(F.count_if(F.col("source_type") == "orchestrator_retrieval").alias("contaminated_rows"))
    keys = ["table_name", "row_count", "content_sum"]
    rows = stored.select(*keys, F.lit(1).alias("s"), F.lit(0).alias("n")).unionByName(now.select(*keys, F.lit(0).alias("s"), F.lit(1).alias("n")))
    pairs = rows.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    same = pairs.agg(F.countDistinct("table_name").alias("tables"),
                     F.countDistinct(F.when(F.col("s") != F.col("n"), F.col("table_name"))).alias("changed_tables"))
    return one_row(dirty, same)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per incident and broken rule."""
    hits = F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules.items()]))
    return df.select(*INCIDENT, F.explode(hits).alias("violation"))


def language_violations(actions: DataFrame, narration: DataFrame) -> DataFrame:
    """Action contexts that contradict themselves, and narratives with model jargon."""
    level, c = F.col("action_level"), F.col
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    advice, ready = F.lower(text("recommended_action")), F.lower(text("action_readiness"))
    act = level == "act"
    rules = {
        "direct action without material driver movement": act & (text("movement_status") != "material_movement"),
        "direct action targets a non-moved driver": act & text("driver_direction").isin("unchanged", "unknown", ""),
        "direct action targets contradictory evidence": act & (c("direction_alignment") == "contradictory"),
        "unexplained case recommends a direct lever": (level == "validate_unexplained")
        & (advice.startswith("work on ") | advice.startswith("prioritize ")),
        "data-quality action does not ask for a rerun": (level == "data_quality_first") & ~advice.contains("rerun"),
        "action readiness is missing": ready == "",
        "act case has no action target": act & (text("action_target_driver") == ""),
        "validation case is labelled action-ready": level.isin("validate", "validate_unexplained") & ready.startswith("act"),
        "explanation and target metadata disagree": F.coalesce("explanation_differs_from_action_target", F.lit(False)) & (
            (text("leading_explanation_driver") == "") | (text("action_target_driver") == "")
            | (c("leading_explanation_driver") == c("action_target_driver"))),
    }
    told = F.concat_ws(" ", "headline", "narrative", F.concat_ws(" ", "caveats"))
    leaked = narration.filter(mentions(told, JARGON)).select(
        *INCIDENT, F.concat(F.col("persona"), F.lit(": narration contains model jargon")).alias("violation"))
    return violations(actions, rules).unionByName(leaked)


def policy_violations(actions: DataFrame, plans: DataFrame, contexts: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Stored plans that break routing, grounding or precision rules."""
    n = retrieved.groupBy(*INCIDENT).agg(F.count("*").alias("n_retrieved"))
    df = actions.select(*INCIDENT, "action_level").join(
        plans.select(*INCIDENT, "clarification_question", "retrieval_query", "retrieval_target"), INCIDENT, "left") \
        .join(n, INCIDENT, "left").fillna({"n_retrieved": 0}) \
        .join(contexts.select(*INCIDENT, "incident_date", "candidates", "anchors"), INCIDENT, "left")
    q, query, target = F.col("clarification_question"), F.col("retrieval_query"), F.col("retrieval_target")
    planned, web, some = q.isNotNull(), target == "web", F.col("n_retrieved") > 0
    marks = F.length(q) - F.length(F.replace(q, F.lit("?"), F.lit("")))
    rules = {
        "sources stored without a plan": ~planned & some,
        "external check ran for a blocked action level": planned & F.col("action_level").isin("monitor", "data_quality_first"),
        "invalid retrieval target": planned & ~target.isin("web", "internal", "none"),
        "web plan has no query": web & (F.coalesce(query, F.lit("")) == ""),
        "non-web plan has a query": planned & ~web & (F.coalesce(query, F.lit("")) != ""),
        "non-web plan has sources": planned & ~web & some,
        "not exactly one question": planned & (marks != 1),
        "web plan has no eligible candidate": web & ~F.exists("candidates", lambda c: c["eligible"]),
        "web plan fails the grounding policy": web & query.isNotNull() & X.plan_problem(q, query, target).isNotNull(),
    }
    return violations(df, rules)


def neutrality(evidence_diff: DataFrame, split_diff: DataFrame, calibration: DataFrame) -> DataFrame:
    """Feedback must change nothing but the bounded readiness figure."""
    return one_row(
        evidence_diff.agg(F.count("*").alias("changed_evidence_rows")), split_diff.agg(F.count("*").alias("changed_decomposition_rows")),
        calibration.agg(F.count_if("applied").alias("calibrated"), F.count_if(F.abs("adjustment") > 0.1000001).alias("out_of_bound")))
