"""Partial reruns over stored documents: read, recompute, write back by key what changed.

Nothing but the tables and the configuration is needed, so a rerun may come from another session than the run. A
document that does not parse, or holds no decision, is left as it stands.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators import bundle as U
from causeway.operators.series import INCIDENT
from causeway.plans import refresh as R
from causeway.session import write_layer
from causeway.sources.tables import Tables

CUTOFF = "decision.action_context.feedback_calibration.analysis_cutoff"


def read_bundles(tables: Tables, needs: str = "decision") -> DataFrame:
    """(incident, bundle) of the documents that hold the part ``needs``, as a layer: the table may change under its reader."""
    rows = U.from_documents(tables.read("evidence_bundle")).filter(f"bundle.{needs} IS NOT NULL")
    return write_layer(rows.select(*INCIDENT, "bundle"), "stored-bundles")


def write_back(tables: Tables, layer: str, old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Store the documents in which anything but the cut-off of the calibration differs; these are returned.

    Both sides are compared as they would be read, so the order of fields and a null that is left out make no difference.
    """
    undated = F.to_json(F.col("bundle").withField(CUTOFF, F.lit(None).cast("string")))
    documents = write_layer(U.to_documents(fresh), "fresh-documents")
    after = U.from_documents(documents).select("*", undated.alias("after"))
    changed = write_layer(after.join(old.select(*INCIDENT, undated.alias("before")), INCIDENT).filter("after <> before")
                          .select(*documents.columns), "changed-documents")
    tables.update(layer, "evidence_bundle", changed, INCIDENT)
    return changed


def refresh_feedback(tables: Tables, feedback: DataFrame, cutoff: dt.datetime) -> DataFrame:
    """Calibrate the stored decisions anew; returns the documents that changed."""
    old = read_bundles(tables, "decision.action_context")
    return write_back(tables, "feedback", old, R.refresh_feedback(old, feedback, cutoff))


def refresh_wording(tables: Tables, drivers: DataFrame, playbook: DataFrame, feedback: DataFrame, cutoff: dt.datetime) -> DataFrame:
    """Actions and narrative anew from the stored evidence and the newest stored weights; returns the documents that changed."""
    old = read_bundles(tables)
    updates = tables.read("orchestrator_updates") if tables.exists("orchestrator_updates") else tables.spark.createDataFrame(
        [], "kpi string, region string, window_start date, driver string, probability_after double, updated_at timestamp")
    return write_back(tables, "wording", old, R.refresh_wording(old, drivers, updates, playbook, feedback, cutoff))


def refresh_external(tables: Tables, drivers: DataFrame, policy: DataFrame, anchors: DataFrame, playbook: DataFrame, feedback: DataFrame,
                     cutoff: dt.datetime, sources: DataFrame, assessments: DataFrame) -> DataFrame:
    """Gate, plan and fusion anew; the stored sources, weights and requests are replaced. Returns the documents that changed."""
    old = read_bundles(tables)
    new = R.external_layers(old, policy, anchors, playbook, feedback, cutoff, sources, assessments, drivers)
    asked = new["plans"].filter("retrieval_target = 'web'").select(*INCIDENT, "retrieval_query")
    tables.write("stage4", "retrieved_context", new["retrieved"])
    tables.write("stage4", "orchestrator_updates", R.weight_changes(new["fused"], asked))
    tables.write("stage4", "clarification_requests", new["plans"].drop("candidates", "anchors"))
    return write_back(tables, "stage4", old, new["bundles"])
