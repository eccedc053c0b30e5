"""Queries over the external-evidence checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import text as T
from causeway.operators import corpus as K
from causeway.operators import external as X
from causeway.operators import fusion as Z
from causeway.operators.series import INCIDENT
from causeway.plans.catalog import query, show
from causeway.plans.workspace import Workspace

KEYS = "kpi region window_start"


@query
def clarification_gate(w: Workspace) -> DataFrame:
    return w.gates


@query
def web_eligibility(w: Workspace) -> DataFrame:
    return w.pools.select(*INCIDENT, F.explode("pool").alias("p")).select(
        *INCIDENT, F.col("p.component").alias("component"), F.col("p.driver").alias("driver"),
        F.col("p.scope").alias("scope"), F.col("p.ready").alias("has_evidence"), F.col("p.eligible").alias("eligible"))


@query
def retrieval_candidates(w: Workspace) -> DataFrame:
    return w.chosen.select(*INCIDENT, F.posexplode("chosen").alias("slot", "c")).select(
        *INCIDENT, F.col("slot").cast("bigint").alias("slot"), F.col("c.driver").alias("driver"))


@query
def retrieval_context(w: Workspace) -> DataFrame:
    return w.contexts.select(*INCIDENT, "direction", "confidence", "decision_type", F.explode("candidates").alias("c")) \
        .select(*INCIDENT, "direction", "confidence", "decision_type", F.col("c.name").alias("name"),
                F.col("c.scope").alias("retrieval_scope"), F.col("c.external_hypothesis").alias("external_hypothesis"))


@query
def retrieval_plan(w: Workspace) -> DataFrame:
    return w.plans.select(*INCIDENT, "clarification_question", "retrieval_query", "retrieval_target", "planner_status")


def proposals(w: Workspace) -> DataFrame:
    """Planner proposals of several kinds, good and bad, chosen by the incident's date."""
    kind = F.datediff("window_start", F.lit("1995-01-01").cast("date")) % 15
    day, region = F.col("window_start").cast("string"), F.col("region")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return w.incidents.select(
        *INCIDENT,
        F.when(kind == 0, "What changed? And why?").when(kind == 1, "Did the coefficient move?")
        .when(kind == 6, "What " + "really " * 80 + "happened?").otherwise(said("What happened in ", region, "?")).alias("clarification_question"),
        F.when(kind == 2, said("storm rainfall ", region, " ", day)).when(kind == 3, said("storm ", region, " 2031"))
        .when(kind == 4, "unrelated words only").when(kind == 9, said("was there a storm in ", region, "?"))
        .when(kind == 10, said("storm " * 26, region)).when(kind == 11, said("storm p-value ", region)).when(kind == 12, said("storm ", F.col("kpi")))
        .when(kind == 13, said("storm ", region)).when(kind == 14, said("competitor price ", region, " ", day)).alias("retrieval_query"),
        F.when(kind.isin(5, 13), "internal").when(kind == 7, "mail").otherwise("web").alias("retrieval_target"))


@query
def plan_validation(w: Workspace) -> DataFrame:
    p = w.contexts.join(proposals(w), INCIDENT)
    return p.select(*INCIDENT, F.coalesce(X.plan_problem(
        F.col("clarification_question"), F.col("retrieval_query"), F.col("retrieval_target")), F.lit("valid")).alias("verdict"))


@query
def plan_normalisation(w: Workspace) -> DataFrame:
    return X.plans(w.contexts, proposals(w)).select(
        *INCIDENT, "clarification_question", "retrieval_query", "retrieval_target", "planner_status", "planner_reason")


@query
def query_words(w: Workspace) -> DataFrame:
    return w.facts.table("documents").select(
        "doc_id", F.size(T.words("text")).cast("bigint").alias("n_words"),
        F.array_join(F.sort_array(T.words("text")), " ").alias("words"),
        F.array_join(F.sort_array(T.years("text")), " ").alias("years"),
        F.array_join(F.sort_array(T.iso_dates("text")), " ").alias("dates"))


@query
def url_canonical(w: Workspace) -> DataFrame:
    return w.facts.table("pages").select("page_id", T.canonical_url("url").alias("canonical_url"))


@query
def page_text(w: Workspace) -> DataFrame:
    return K.page_corpus(w.facts.table("pages")).select("doc_id", "title", "body", T.fetch_status("body").alias("fetch_status"))


@query
def json_extract(w: Workspace) -> DataFrame:
    rows = w.facts.table("events").select("event_id", F.concat(F.lit("```json\nAnswer: "), F.col("props"), F.lit("\n```")).alias("t"))
    return rows.select("event_id", F.from_json(T.json_object("t"), "k bigint")["k"].alias("k"))


@query
def corpus_search(w: Workspace) -> DataFrame:
    """Documents that repeat passages of the benchmark items."""
    docs = w.facts.table("documents").select(
        "doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_url"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))
    item = F.filter(T.words("text"), lambda t: F.length(t) >= 6)
    asked = w.facts.table("benchmark").select(F.col("text").alias("query"), F.element_at(F.sort_array(item), 1).alias("anchor"))
    return K.search(docs, asked).select(F.md5("search").alias("search_key"), F.col("search_rank").cast("bigint").alias("search_rank"),
                                        "doc_id")


@query
def retrieved_sources(w: Workspace) -> DataFrame:
    return show(w.sources, f"{KEYS} source_index doc_id source_url")


@query
def assessment_cleanup(w: Workspace) -> DataFrame:
    return show(w.assessments, f"{KEYS} source_index hypothesis reason", "support confidence")


@query
def support_aggregate(w: Workspace) -> DataFrame:
    return show(w.supports, f"{KEYS} hypothesis n_sources_scored", "weighted_support retrieval_confidence effective_support")


@query
def single_hypothesis_support(w: Workspace) -> DataFrame:
    return show(Z.one_hypothesis(w.supports, "competitor_price_index"), KEYS, "support confidence")


@query
def fusion_reweight(w: Workspace) -> DataFrame:
    return show(w.fused, f"{KEYS} component driver", "softmax_probability:5 fused_probability:5 retrieval_support")


@query
def fusion_updates(w: Workspace) -> DataFrame:
    """Audit rows of every fused incident."""
    rows = w.fused.join(w.web_plans.select(*INCIDENT, "retrieval_query"), INCIDENT)
    return show(rows.withColumnRenamed("softmax_probability", "probability_before")
                .withColumnRenamed("fused_probability", "probability_after"),
                f"{KEYS} component driver retrieval_query", "probability_before:5 retrieval_support probability_after:5")


@query
def driver_probabilities(w: Workspace) -> DataFrame:
    return show(Z.best_per_driver(w.evidence), f"{KEYS} driver", "probability", 5)


@query
def stage4_status(w: Workspace) -> DataFrame:
    return Z.stage_status(w.gates, w.plans, w.supports, w.evidence)
