"""One run from stored raw tables to stored analysis tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from causeway.operators import bundle as U
from causeway.operators.series import INCIDENT
from causeway.plans.refresh import weight_changes
from causeway.plans.workspace import Workspace
from causeway.sources.raw import RawFacts
from causeway.sources.tables import Tables

CHANGEPOINT = ["kpi", "region", "changepoint_date"]
PAIR = [*INCIDENT, "component", "driver"]
SPLIT = [*INCIDENT, "decomposition_type", "component_a", "component_b", "a0", "a1", "b0", "b1", "total_change", "effect_a", "effect_b",
         "interaction_effect", "residual", "is_volatile", "narrative_mode", "kpi_baseline", "percent_change", "is_material"]


def run(tables: Tables, cutoff: dt.datetime | None = None, anchors: DataFrame | None = None, corpus: DataFrame | None = None,
        assessments: DataFrame | None = None) -> Workspace:
    """Detect, explain and store.

    Results replace earlier ones of the same key and leave others alone; logs are appended, and every
    step leaves a telemetry row, also when it fails. External evidence is asked for only with a
    corpus; ``anchors`` (incident, key, value) and ``assessments`` come from the caller.
    """
    tables.recover()
    base = Workspace(tables.spark, facts=RawFacts(tables), cutoff=cutoff)
    given = {"anchors": anchors, "corpus": corpus, "raw_assessments": assessments}
    base.__dict__.update({k: v for k, v in given.items() if v is not None})
    w = base.detected
    w.__dict__.update({k: v for k, v in given.items() if v is not None})
    with tables.timed("detect changepoints"):
        tables.upsert("analysis", "detected_changepoints", base.changepoints, CHANGEPOINT)
    with tables.timed("decompose"):
        tables.upsert("analysis", "pvm_decomposition", w.decomposed.select(*SPLIT), INCIDENT)
    with tables.timed("score drivers"):
        scored = w.evidence
        tables.upsert("analysis", "driver_evidence", scored, PAIR)
    with tables.timed("decide"):
        tables.upsert("analysis", "decision_packets", w.packets, INCIDENT)
    if corpus is not None:
        with tables.timed("external evidence"):
            tables.append("stage4", "retrieved_context", w.retrieved)
            tables.append("stage4", "orchestrator_updates", weight_changes(w.fused, w.web_plans.select(*INCIDENT, "retrieval_query")))
            tables.append("stage4", "clarification_requests", w.plans.drop("candidates", "anchors"))
        with tables.timed("bundle"):
            tables.upsert("analysis", "evidence_bundle", U.to_documents(w.bundles), INCIDENT)
    return w
