"""Partial reruns from stored bundles: external evidence, feedback or wording only.

Layers that several later steps read are written once, so that plans stay short.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators import action as A
from causeway.operators import bundle as U
from causeway.operators import external as X
from causeway.operators import feedback as B
from causeway.operators import fusion as Z
from causeway.operators.narrative import narrate
from causeway.operators.series import INCIDENT
from causeway.operators.serving import enrich, latest_fused
from causeway.session import write_layer


def stored(bundles: DataFrame) -> dict[str, DataFrame]:
    """The flat layers inside stored bundles."""
    b = bundles
    return {
        "evidence": b.select(*INCIDENT, F.explode("bundle.deterministic_evidence.ranked_drivers").alias("r"))
                     .select(*INCIDENT, "r.*"),
        "packets": b.select(*INCIDENT, "bundle.decomposition.*", "bundle.decision.*").drop("components", "action_context")
                    .select("*", "source_health.*").drop("source_health"),
        "impacts": b.select(*INCIDENT, F.explode("bundle.decomposition.components").alias("c")).select(*INCIDENT, "c.*"),
        "plans": b.filter("bundle.retrieval_plan IS NOT NULL").select(*INCIDENT, "bundle.retrieval_plan.*"),
        "retrieved": b.select(*INCIDENT, F.explode("bundle.retrieved_evidence").alias("r")).select(*INCIDENT, "r.*"),
        "calibration": b.select(*INCIDENT, F.col("bundle.decision.action_context.feedback_calibration").alias("cal")),
    }


def weight_changes(fused: DataFrame, asked: DataFrame) -> DataFrame:
    """Audit rows of the incidents whose weights external evidence may have changed. ``asked``: (incident, retrieval_query)."""
    return fused.join(asked, INCIDENT).select(
        *INCIDENT, "component", "driver", "retrieval_query", F.col("softmax_probability").alias("probability_before"),
        "retrieval_support", F.col("fused_probability").alias("probability_after"), F.current_timestamp().alias("updated_at"))


def without_totals(packets: DataFrame) -> DataFrame:
    """total_change is stored in the decomposition and in the decision; keep one."""
    names, out = set(), []
    for i, c in enumerate(packets.columns):
        if c not in names:
            out.append(i)
            names.add(c)
    flat = packets.toDF(*[f"_{i}" for i in range(len(packets.columns))])
    return flat.select(*[F.col(f"_{i}").alias(packets.columns[i]) for i in out])


def layers(bundles: DataFrame, drivers: DataFrame | None = None) -> dict[str, DataFrame]:
    """The stored parts with the three that every rerun reads written as tables; ``drivers`` fills what older rows lack."""
    parts = stored(bundles)
    if drivers is not None:
        parts["evidence"] = enrich(parts["evidence"], drivers)
    parts["packets"] = without_totals(parts["packets"])
    return parts | {name: write_layer(parts[name], name) for name in ("evidence", "packets", "impacts")}


def rebuild(parts: dict[str, DataFrame], evidence: DataFrame, plans: DataFrame, retrieved: DataFrame,
            playbook: DataFrame, feedback: DataFrame, cutoff: dt.datetime) -> DataFrame:
    """Actions, calibration, narrative and bundle from given evidence; the calibration is always re-applied."""
    packets = parts["packets"]
    flat = write_layer(A.action_context(packets, evidence, parts["impacts"], playbook), "actions")
    signal = B.calibration(flat, feedback, cutoff)
    counts = retrieved.groupBy(*INCIDENT).agg(F.count("*").alias("n_retrieved"))
    return U.bundles(packets, parts["impacts"], evidence, B.attach(A.as_struct(flat), signal), plans, retrieved,
                     narrate(packets, flat, counts))


def external_layers(bundles: DataFrame, policy: DataFrame, anchors: DataFrame, playbook: DataFrame, feedback: DataFrame,
                    cutoff: dt.datetime, sources: DataFrame, raw_assessments: DataFrame,
                    drivers: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rerun gate, plan and fusion from stored deterministic evidence; earlier fusion is dropped first.

    Gives the new ``bundles``, and the ``plans``, ``retrieved`` sources and ``fused`` weights behind them.
    """
    parts = layers(bundles, drivers)
    evidence = parts["evidence"].withColumn("fused_probability", F.col("softmax_probability"))
    packets = parts["packets"]
    actions = write_layer(A.action_context(packets, evidence, parts["impacts"], playbook), "actions")
    pools = write_layer(X.pool(actions, evidence, policy, anchors), "pools")
    open_ = X.gate(packets, actions, pools).filter("clarification_needed").select(*INCIDENT)
    plans = write_layer(X.plans(X.contexts(packets, X.candidates(pools))).join(open_, INCIDENT, "left_semi"), "plans")
    web = plans.filter("retrieval_target = 'web'")
    hypotheses = web.select(*INCIDENT, F.explode("candidates").alias("c")).select(
        *INCIDENT, F.col("c.name").alias("hypothesis"), F.col("c.component").alias("component"))
    sources = sources.join(web, INCIDENT, "left_semi")
    assessed = write_layer(Z.complete(Z.clean_assessments(raw_assessments, sources, hypotheses), sources, hypotheses),
                           "assessments")
    supports = Z.support(assessed).join(hypotheses, [*INCIDENT, "hypothesis"]).withColumnRenamed("hypothesis", "driver")
    fused = write_layer(Z.fuse(evidence.drop("fused_probability", "retrieval_support"), supports), "fused")
    retrieved = sources.join(assessed, [*INCIDENT, "source_index"])
    return {"bundles": rebuild(parts, fused, plans, retrieved, playbook, feedback, cutoff),
            "plans": plans, "retrieved": retrieved, "fused": fused}


def refresh_external(*given: DataFrame | dt.datetime, **more: DataFrame) -> DataFrame:
    """The new bundles of ``external_layers``."""
    return external_layers(*given, **more)["bundles"]


def refresh_feedback(bundles: DataFrame, feedback: DataFrame, cutoff: dt.datetime) -> DataFrame:
    """Replace the calibration in stored bundles; nothing else changes."""
    act = F.col("bundle.decision.action_context")
    rows = bundles.withColumn("action_context", act)
    decisions = bundles.select(*INCIDENT, act["primary_driver"].alias("primary_driver"), act["action_level"].alias("action_level"))
    fresh = B.attach(rows.withColumn("action_context", F.col("action_context").dropFields("feedback_calibration")),
                     B.calibration(decisions, feedback, cutoff))
    return fresh.withColumn("bundle", F.col("bundle").withField("decision.action_context", F.col("action_context"))) \
                .select(*INCIDENT, "bundle")


def refresh_wording(bundles: DataFrame, drivers: DataFrame, updates: DataFrame, playbook: DataFrame, feedback: DataFrame,
                    cutoff: dt.datetime) -> DataFrame:
    """Rebuild actions and narrative from stored evidence; legacy rows get their contract semantics."""
    parts = layers(bundles, drivers)
    evidence = write_layer(latest_fused(parts["evidence"], updates), "evidence")
    return rebuild(parts, evidence, parts["plans"], parts["retrieved"], playbook, feedback, cutoff)
