"""Plain-language text per incident and persona."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.wording import CAVEATS, JARGON, N, fill, friendly, mentions
from causeway.operators.series import INCIDENT

PERSONAS = ("Executive", "Growth analyst")


def kept(*parts: Column) -> Column:
    """The non-empty parts, in order and without repeats."""
    return F.array_distinct(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")))


def sentence(template: str, when: Column | None = None, **cols: Column) -> Column:
    out = fill(template, **cols)
    return out if when is None else F.when(when, out)


def present(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def caveats() -> Column:
    """Freshness, interaction, external context and ambiguity notes."""
    level = F.col("action_level")
    mixed = (F.col("narrative_mode") == "complex_interaction") | F.coalesce("is_volatile", F.lit(False))
    return kept(
        F.col("freshness_caveat"), F.when(mixed, CAVEATS["complex"]),
        F.when(F.coalesce("n_retrieved", F.lit(0)) > 0, CAVEATS["external"]),
        F.when(level == "validate_unexplained", CAVEATS["unexplained"])
        .when(F.coalesce("is_ambiguous", F.lit(False)) & (level != "data_quality_first"), CAVEATS["ambiguous"]))


def narrate(packets: DataFrame, actions: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """(incident, persona, headline, narrative, caveats, leaked). ``retrieved`` counts sources per incident."""
    df = packets.select(*INCIDENT, "percent_change", "freshness_caveat", "narrative_mode", "is_volatile") \
                .join(actions, INCIDENT)
    counts = retrieved if retrieved is not None else packets.select(*INCIDENT, F.lit(0).alias("n_retrieved"))
    df = df.join(counts.select(*INCIDENT, "n_retrieved"), INCIDENT, "left")
    df = df.withColumn("persona", F.explode(F.array(*[F.lit(p) for p in PERSONAS])))
    c, kpi, region = F.col, friendly("kpi"), F.col("region")
    change = c("percent_change")
    verb = F.when(change.isNull(), "changed").when(change > 0, "increased").when(change < 0, "decreased") \
            .otherwise("was broadly unchanged")
    amount = F.when(change.isNull(), "changed from a near-zero baseline").when(change == 0, verb).otherwise(
        F.format_string("%s by %.1f%%", verb, F.abs(change) * 100))
    level = c("action_level")
    todo = F.when(level == "act", "work on").otherwise("validate")
    trust, ready = c("evidence_confidence"), c("action_readiness")
    driver, component = c("primary_driver_label"), c("primary_component_label")
    opening = fill(N["opening"], kpi=kpi, change=amount, region=region)
    texts = [c("finding"), c("why_it_matters"), c("next_check"), c("action_if_confirmed")]
    other = (
        sentence(N["two_signals"], present("leading_explanation_driver_label") & present("action_target_driver_label")
                 & (c("leading_explanation_driver_label") != c("action_target_driver_label")),
                 explanation=c("leading_explanation_driver_label"), target=c("action_target_driver_label")),
        sentence(N["mechanism"], present("mechanism_chain") & present("upstream_driver_label"), chain=c("mechanism_chain"),
                 upstream=c("upstream_driver_label"), driver=driver),
        F.when(present("primary_component_label") & present("primary_driver_label"),
               fill(N["path"], verb=todo, driver=driver, component=component, kpi=kpi))
        .when(present("primary_driver_label"), fill(N["issue"], verb=todo, driver=driver)),
        texts[0], texts[1], sentence(N["check_now"], present("next_check"), check=texts[2]),
        sentence(N["confirmed"], present("action_if_confirmed"), action=texts[3]),
        sentence(N["owner"], (c("persona") == "Growth analyst") & present("owner"), owner=c("owner")),
        F.when(present("secondary_driver_label"), c("secondary_check")),
        fill(N["close"], confidence=trust, readiness=ready))
    lower = dict(confidence=trust, readiness=F.lower(ready))
    body = (
        F.when(level == "data_quality_first", kept(opening, texts[0], texts[2], texts[3], fill(N["health_close"], **lower)))
        .when(level == "monitor", kept(opening, texts[0], texts[2]))
        .when(level == "validate_unexplained", kept(opening, texts[0], texts[1], sentence(
            N["check_next"], present("next_check"), check=texts[2]), texts[3], fill(N["unexplained_close"], **lower)))
        .otherwise(kept(opening, *other)))
    headline = (
        F.when(level == "data_quality_first", fill(N["head_health"], kpi=kpi, region=region))
        .when(level == "monitor", fill(N["head_monitor"], kpi=kpi, region=region))
        .when(level == "validate_unexplained", fill(N["head_unexplained"], kpi=kpi, verb=verb, region=region,
                                                    component=F.coalesce(component, F.lit("KPI"))))
        .when(present("primary_driver_label"), fill(N["head_driver"], kpi=kpi, verb=verb, region=region, driver=driver,
                                                    todo=todo))
        .otherwise(fill(N["head_none"], kpi=kpi, verb=verb, region=region)))
    out = df.select(*INCIDENT, "persona", headline.alias("headline"), F.array_join(body, " ").alias("narrative"),
                    caveats().alias("caveats"))
    return out.withColumn("leaked", leaks(F.concat_ws(" ", "headline", "narrative", F.concat_ws(" ", "caveats"))))


def leaks(text: Column) -> Column:
    """Whether a text contains model jargon."""
    return mentions(text, JARGON)
