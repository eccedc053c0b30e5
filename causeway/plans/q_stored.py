"""Queries that store documents, rerun a part from the stored tables alone and read the result back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators import bundle as U
from causeway.operators import serving as V
from causeway.operators.series import INCIDENT
from causeway.plans import refresh as R
from causeway.plans import stored as P
from causeway.plans.catalog import query, show
from causeway.plans.q_model import scratch
from causeway.plans.workspace import Workspace
from causeway.sources.tables import Tables

KEYS = "kpi region window_start"
ACTION = "bundle.decision.action_context"


def kept(w: Workspace, bundles: DataFrame) -> Tables:
    tables = scratch(w)
    tables.upsert("analysis", "evidence_bundle", U.to_documents(bundles), INCIDENT)
    return tables


def drivers_with(change: Column) -> Column:
    """The bundle with its ranked drivers replaced."""
    return F.col("bundle").withField("deterministic_evidence.ranked_drivers", change)


def before_external(bundles: DataFrame) -> DataFrame:
    """The documents of a run without external evidence."""
    plain = F.transform("bundle.deterministic_evidence.ranked_drivers", lambda r: r.withField(
        "fused_probability", r["softmax_probability"]).withField("retrieval_support", F.lit(None).cast("double")))
    none = lambda name: F.lit(None).cast(bundles.schema["bundle"].dataType[name].dataType)
    return bundles.select(*INCIDENT, drivers_with(plain).withField("retrieval_plan", none("retrieval_plan"))
                          .withField("retrieved_evidence", none("retrieved_evidence")).alias("bundle"))


def older(bundles: DataFrame) -> DataFrame:
    """Documents of before contract semantics, fused weights and actions were kept in them."""
    lean = F.transform("bundle.deterministic_evidence.ranked_drivers", lambda r: r.dropFields(
        "causal_role", "mediates_through", "expected_effect_sign", "source_cadence_days", "lag_resolution_days", "fused_probability"))
    return bundles.select(*INCIDENT, drivers_with(lean).dropFields("decision.action_context", "narration").alias("bundle"))


@query
def stored_feedback_refresh(w: Workspace) -> DataFrame:
    """Documents from before any rating, calibrated anew once ratings are there."""
    tables = kept(w, R.refresh_feedback(w.bundles, w.feedback.filter(F.lit(False)), w.cutoff))
    P.refresh_feedback(tables, w.feedback, w.cutoff)
    return show(V.calibration_cards(P.read_bundles(tables)), f"{KEYS} sample_count", "adjustment adjusted_readiness_score")


@query
def stored_feedback_changes(w: Workspace) -> DataFrame:
    """The documents that the ratings of one KPI change; the others are not written."""
    tables = kept(w, R.refresh_feedback(w.bundles, w.feedback.filter(F.lit(False)), w.cutoff))
    changed = P.refresh_feedback(tables, w.feedback.filter("kpi = 'revenue'"), w.cutoff)
    return changed.select(*INCIDENT)


@query
def stored_external_refresh(w: Workspace) -> DataFrame:
    """Documents of a run without external evidence, fused anew once sources are there."""
    tables = kept(w, before_external(w.bundles))
    P.refresh_external(tables, w.drivers, w.policy_rows, w.anchors, w.playbook_rows, w.feedback, w.cutoff, w.sources, w.raw_assessments)
    ranked = P.read_bundles(tables).select(*INCIDENT, F.explode("bundle.deterministic_evidence.ranked_drivers").alias("r"))
    return show(ranked.select(*INCIDENT, "r.component", "r.driver", "r.fused_probability"), f"{KEYS} component driver", "fused_probability", 5)


@query
def stored_wording_refresh(w: Workspace) -> DataFrame:
    """Older documents get what they lack from the contracts and the stored weights, then actions and narrative."""
    tables = kept(w, older(w.bundles))
    tables.append("stage4", "orchestrator_updates", R.weight_changes(w.fused, w.web_plans.select(*INCIDENT, "retrieval_query")))
    P.refresh_wording(tables, w.drivers, w.playbook_rows, w.feedback, w.cutoff)
    return P.read_bundles(tables).select(*INCIDENT, *[F.col(f"{ACTION}.{c}").alias(c) for c in ("action_level", "primary_driver", "secondary_driver")])
