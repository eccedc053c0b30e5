"""Layers of one run over one folder of tables.

A layer that several later steps read is written once as Parquet; everything else
stays a lazy DataFrame.
"""

from __future__ import annotations

import datetime as dt
from collections import Counter
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import action as A
from causeway.operators import bundle as U
from causeway.operators import corpus as K
from causeway.operators import decision as C
from causeway.operators import decompose as D
from causeway.operators import evidence as E
from causeway.operators import external as X
from causeway.operators import feedback as B
from causeway.operators import fusion as Z
from causeway.operators import health as H
from causeway.operators import lags as L
from causeway.operators import mart as M
from causeway.operators import series as S
from causeway.operators.changepoints import detect
from causeway.operators.model import Fitted, fitted_model
from causeway.operators.narrative import narrate
from causeway.operators.series import INCIDENT
from causeway.session import drop_layers, tune, write_layer
from causeway.sources.contracts import (
    driver_dim, driver_names, load_contracts, load_playbook, load_policy, playbook_dim,
    policy_dim, source_dim)
from causeway.sources.testbed import Testbed


class Workspace:
    """All layers over one folder.

    Incidents are the largest yearly shifts and evidence uses the correlation model, which
    SQL can restate; ``detected`` is the same run over the detected changepoints with the
    fitted model.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, facts=None, cutoff: dt.datetime | None = None):
        """Over the test tables at ``path``, or over ``facts``: any object with the raw schema's frames (``RawFacts``)."""
        self.spark = tune(spark)
        self.facts = Testbed(spark, path) if facts is None else facts
        self.contracts = load_contracts()
        self.policy = load_policy()
        self.playbook = load_playbook()
        self.cutoff = cutoff or dt.datetime(2024, 1, 20, tzinfo=dt.timezone.utc)

    @cached_property
    def mart_plan(self) -> DataFrame:
        f = self.facts.ready()
        return M.daily_mart(f.sales, f.marketing, f.market_context, f.customer_success)

    @cached_property
    def mart(self) -> DataFrame:
        """The facts it is made of keep the prints that were taken while they were written."""
        return write_layer(self.mart_plan, "mart")

    def prints(self) -> DataFrame:
        """(table_name, row_count, content_sum) of the facts as they are now."""
        return self.facts.prints()

    @cached_property
    def raw_prints(self) -> DataFrame:
        return self.facts.stored_prints()

    @cached_property
    def series(self) -> DataFrame:
        return S.kpi_series(self.mart, self.contracts)

    @cached_property
    def shifts(self) -> DataFrame:
        return S.local_shifts(self.series)

    @cached_property
    def incidents(self) -> DataFrame:
        """The largest shift of each (kpi, region, year)."""
        return write_layer(S.largest_shifts(self.shifts), "incidents")

    @cached_property
    def windows(self) -> DataFrame:
        return S.incident_windows(self.incidents, self.mart, S.contract_columns(self.contracts))

    @cached_property
    def components(self) -> DataFrame:
        return S.component_rows(self.windows, self.contracts)

    @cached_property
    def levels(self) -> DataFrame:
        return S.half_window_means(self.components)

    @cached_property
    def sides(self) -> DataFrame:
        return D.sides(self.levels, self.contracts)

    @cached_property
    def decomposed(self) -> DataFrame:
        return write_layer(D.relative_change(D.decompose(self.sides)), "decomposition")

    @cached_property
    def drivers(self) -> DataFrame:
        return driver_dim(self.spark, self.contracts)

    @cached_property
    def pairs(self) -> DataFrame:
        return L.cluster(S.pair_rows(self.windows, self.contracts))

    @cached_property
    def periods(self) -> DataFrame:
        return L.period_means(self.pairs)

    @cached_property
    def lag_correlations(self) -> DataFrame:
        most = max(d.steps for c in self.contracts.values() for d in c.drivers)
        return L.lag_correlations(self.periods, most)

    @cached_property
    def lags(self) -> DataFrame:
        return L.best_lags(self.lag_correlations)

    @cached_property
    def signals(self) -> DataFrame:
        """Written once: the model, the scores and the audits all start here."""
        return write_layer(E.signals(E.profiles(self.pairs), self.lags, self.drivers), "signals")

    @cached_property
    def correlation_model(self) -> DataFrame:
        return E.correlation_model(self.signals)

    @cached_property
    def fitted(self) -> Fitted:
        most = max(Counter((c.kpi, d.explains) for c in self.contracts.values() for d in c.drivers).values())
        return fitted_model(self.signals, most)

    @cached_property
    def model(self) -> DataFrame:
        return write_layer(self.fitted.table, "model")

    def relationship(self) -> DataFrame:
        return self.correlation_model

    @cached_property
    def evidence(self) -> DataFrame:
        return write_layer(E.weights(E.score(self.signals, self.relationship())), "evidence")

    @cached_property
    def playbook_rows(self) -> DataFrame:
        return playbook_dim(self.spark, self.playbook, driver_names(self.contracts))

    @cached_property
    def required(self) -> DataFrame:
        return H.required_sources(self.incidents, H.dependencies(self.drivers, source_dim(self.spark)))

    @cached_property
    def health_as_of(self) -> DataFrame:
        return H.health_as_of(self.required, self.health)

    @cached_property
    def health(self) -> DataFrame:
        return write_layer(self.facts.source_health, "health")

    @cached_property
    def verdicts(self) -> DataFrame:
        return H.verdict(H.graded(self.health_as_of))

    @cached_property
    def packets(self) -> DataFrame:
        return write_layer(C.packets(self.decomposed, self.impacts, self.evidence, self.verdicts), "packets")

    @cached_property
    def actions(self) -> DataFrame:
        """Action context before external evidence."""
        return write_layer(A.action_context(self.packets, self.evidence, self.impacts, self.playbook_rows), "actions")

    @cached_property
    def feedback(self) -> DataFrame:
        patterns = [(c.kpi, d.name, level) for c in self.contracts.values() for d in c.drivers
                    for level in ("act", "validate", "validate_unexplained")]
        return self.facts.feedback(patterns)

    @cached_property
    def calibration(self) -> DataFrame:
        return B.calibration(self.actions, self.feedback, self.cutoff)

    # External evidence.

    @cached_property
    def anchors(self) -> DataFrame:
        """Named anchors for the test tables: per region the commonest first title word of all its pages."""
        word = F.regexp_extract(F.lower("html"), "<title>[^a-z]*([a-z]+)", 1)
        counts = self.facts.table("pages").select((F.col("page_id") % 5).alias("rk"), word.alias("value")).filter("value <> ''") \
            .groupBy("rk", "value").agg(F.count("*").alias("n"))
        common = counts.groupBy("rk").agg(F.min(F.struct((-F.col("n")).alias("o"), "value")).alias("m"))
        named = common.join(self.facts.table("region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("region")),
                            "rk").select("region", F.col("m.value").alias("value"))
        return self.incidents.join(named, "region").select(*INCIDENT, F.lit("competitor_name").alias("key"), "value")

    @cached_property
    def policy_rows(self) -> DataFrame:
        return policy_dim(self.spark, self.policy, driver_names(self.contracts))

    @cached_property
    def pools(self) -> DataFrame:
        return write_layer(X.pool(self.actions, self.evidence, self.policy_rows, self.anchors), "pools")

    @cached_property
    def gates(self) -> DataFrame:
        return X.gate(self.packets, self.actions, self.pools)

    @cached_property
    def chosen(self) -> DataFrame:
        return X.candidates(self.pools)

    @cached_property
    def contexts(self) -> DataFrame:
        return X.contexts(self.packets, self.chosen)

    @cached_property
    def all_plans(self) -> DataFrame:
        return write_layer(X.plans(self.contexts), "plans")

    @cached_property
    def plans(self) -> DataFrame:
        """Plans of the incidents that need clarification."""
        return self.all_plans.join(self.gates.filter("clarification_needed").select(*INCIDENT), INCIDENT, "left_semi")

    @cached_property
    def corpus(self) -> DataFrame:
        """Pages as a corpus. The test pages name no place, so each is given the region and event word of its id."""
        place = self.facts.table("region").select(F.col("r_regionkey").cast("bigint").alias("rk"), "r_name")
        event = F.element_at(F.array(*[F.lit(x) for x in ("storm", "rainfall", "price", "notice")]),
                             (F.col("doc_id") % 4 + 1).cast("int"))
        pages = K.page_corpus(self.facts.table("pages")).withColumn("rk", F.col("doc_id") % 5).join(place, "rk")
        return write_layer(pages.withColumn("body", F.concat_ws(" ", "body", "r_name", event)).drop("rk", "r_name"), "corpus")

    @cached_property
    def web_plans(self) -> DataFrame:
        return self.plans.filter("retrieval_target = 'web' AND retrieval_query IS NOT NULL")

    @cached_property
    def sources(self) -> DataFrame:
        """Retrieved sources per incident."""
        asked = self.web_plans.select(*INCIDENT, F.col("retrieval_query").alias("query"), F.coalesce(
            X.named_region(), F.try_element_at("anchors", F.lit(1))["value"]).alias("anchor"))
        found = K.search(self.corpus, asked)
        return write_layer(asked.join(found, F.col("query") == F.col("search")).select(
            *INCIDENT, F.col("search_rank").alias("source_index"), "doc_id", "query", F.col("title").alias("source_title"),
            "source_url", F.col("body").alias("retrieved_text")), "sources")

    @cached_property
    def hypotheses(self) -> DataFrame:
        return self.web_plans.select(*INCIDENT, F.explode("candidates").alias("c")).select(
            *INCIDENT, F.col("c.name").alias("hypothesis"), F.col("c.component").alias("component"))

    @cached_property
    def raw_assessments(self) -> DataFrame:
        """Test assessments made from ids: some repeated, some out of range, some unknown, some absent."""
        names = self.hypotheses.select(*INCIDENT, "hypothesis").unionByName(
            self.web_plans.select(*INCIDENT, F.lit("unknown_driver").alias("hypothesis")))
        size = F.length("hypothesis")
        rows = self.sources.select(*INCIDENT, "source_index", "doc_id").join(names, INCIDENT) \
            .filter((F.col("doc_id") + size) % 5 != 0)
        two = rows.withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1))))
        return two.withColumn("support", ((F.col("doc_id") * 7 + size + F.col("seq")) % 40) / 20.0 - 0.75) \
                  .withColumn("confidence", ((F.col("doc_id") + size + F.col("seq")) % 13) / 10.0) \
                  .withColumn("reason", F.lit("word overlap"))

    @cached_property
    def assessments(self) -> DataFrame:
        clean = Z.clean_assessments(self.raw_assessments, self.sources, self.hypotheses)
        return Z.complete(clean, self.sources, self.hypotheses)

    @cached_property
    def supports(self) -> DataFrame:
        return write_layer(Z.support(self.assessments).join(self.hypotheses, [*INCIDENT, "hypothesis"]), "supports")

    @cached_property
    def fused(self) -> DataFrame:
        return write_layer(Z.fuse(self.evidence, self.supports.withColumnRenamed("hypothesis", "driver")), "fused")

    @cached_property
    def final_actions(self) -> DataFrame:
        """Action context after the weights were fused."""
        return write_layer(A.action_context(self.packets, self.fused, self.impacts, self.playbook_rows), "final-actions")

    @cached_property
    def final_calibration(self) -> DataFrame:
        return B.calibration(self.final_actions, self.feedback, self.cutoff)

    @cached_property
    def retrieved(self) -> DataFrame:
        return self.sources.join(self.assessments, [*INCIDENT, "source_index"])

    @cached_property
    def narration(self) -> DataFrame:
        counts = self.retrieved.groupBy(*INCIDENT).agg(F.count("*").alias("n_retrieved"))
        return narrate(self.packets, self.final_actions, counts)

    @cached_property
    def bundles(self) -> DataFrame:
        told = B.attach(A.as_struct(self.final_actions), self.final_calibration)
        return write_layer(U.bundles(self.packets, self.impacts, self.fused, told, self.plans, self.retrieved,
                                     self.narration), "bundles")

    @cached_property
    def changepoints(self) -> DataFrame:
        return write_layer(detect(self.series, self.mart, self.contracts), "changepoints")

    @cached_property
    def detected(self) -> DetectedRun:
        return DetectedRun(self)

    @cached_property
    def impacts(self) -> DataFrame:
        return D.component_impacts(self.decomposed)



class DetectedRun(Workspace):
    """The full run: incidents are detected changepoints and evidence uses the fitted model."""

    def __init__(self, base: Workspace):
        self.__dict__.update(spark=base.spark, facts=base.facts, contracts=base.contracts, policy=base.policy,
                             playbook=base.playbook, cutoff=base.cutoff,
                             health=base.health, mart=base.mart, changepoints=base.changepoints)
        self.base = base

    @cached_property
    def corpus(self) -> DataFrame:
        return self.base.corpus

    @cached_property
    def incidents(self) -> DataFrame:
        return self.changepoints.select("kpi", "region", F.col("changepoint_date").alias("window_start"))

    def relationship(self) -> DataFrame:
        return self.model


_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, path: str) -> Workspace:
    """One workspace per application and folder, so queries share the written layers."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, path)
    return _OPEN[key]


def forget(spark: SparkSession | None = None) -> None:
    """Drop the memo, e.g. before timing a query on its own or after the tables changed; with a session, its layers too."""
    _OPEN.clear()
    if spark is not None:
        drop_layers(spark)
