"""The rules of KPI contracts as queries over contracts kept as rows; every violation is listed.

``kpis``: (kpi, formula). ``components``: (kpi, component), a row for each declaration. ``drivers``: (kpi, driver,
component, ordinal, max_lag, cadence, causal_role, mediates_through, expected_effect_sign). Of a driver that is
declared for several components, the last declaration is the one that others act through. A null figure or
role is a violation; a null or blank mediator is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.sources.contracts import ROLES, SIGNS

KEYS = ["kpi", "rule", "subject"]


def formula_kind(formula: Column) -> Column:
    """multiply, divide, mixed or single, by the signs on the right-hand side."""
    right = F.regexp_extract(formula, "(?s)=(.*)", 1)
    times, over = right.rlike("[*×]"), right.rlike("[/÷]")
    return F.when(times & over, "mixed").when(times, "multiply").when(over, "divide").otherwise("single")


def named(df: DataFrame, rule: str, subject: Column) -> DataFrame:
    return df.select("kpi", F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def shape_violations(kpis: DataFrame, components: DataFrame) -> DataFrame:
    """No components, a component declared twice, a formula that mixes signs or lacks one of its two components."""
    counts = components.groupBy("kpi").agg(F.countDistinct("component").alias("distinct"), F.count("*").alias("n"))
    sized = kpis.withColumn("kind", formula_kind(F.col("formula"))).join(counts, "kpi", "left").fillna({"n": 0})
    return reduce(DataFrame.unionByName, [
        named(sized.filter("n = 0"), "no components", F.lit(None)),
        named(sized.filter("formula IS NULL"), "no formula", F.lit(None)),
        named(sized.filter("kind = 'mixed'"), "formula mixes signs", F.col("formula")),
        named(sized.filter("kind IN ('multiply', 'divide') AND n <> 2"), "formula needs two components", F.col("kind")),
        named(repeated(components, ["kpi", "component"]), "component declared twice", F.col("component"))])


def driver_violations(components: DataFrame, drivers: DataFrame) -> DataFrame:
    """Figures and words out of range, undeclared components, repeated drivers, mediators that are unknown or elsewhere."""
    word = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    ranges = {"max_lag below 0": F.coalesce(F.col("max_lag") < 0, F.lit(True)),
              "cadence below 1": F.coalesce(F.col("cadence") < 1, F.lit(True)),
              "unknown role": ~word("causal_role").isin(*ROLES), "unknown sign": ~word("expected_effect_sign").isin(*SIGNS)}
    broken = F.array_compact(F.array(*[F.when(cond, rule) for rule, cond in ranges.items()]))
    declared = components.select("kpi", "component").distinct()
    home = drivers.groupBy("kpi", F.col("driver").alias("mediator")).agg(F.max_by("component", "ordinal").alias("home"))
    acting = drivers.withColumn("mediator", F.trim("mediates_through")).filter("mediator <> ''").join(home, ["kpi", "mediator"], "left")
    path = F.concat_ws(" > ", "driver", "mediator")
    return reduce(DataFrame.unionByName, [
        drivers.select("kpi", F.explode(broken).alias("rule"), F.col("driver").alias("subject")),
        named(drivers.join(declared, ["kpi", "component"], "left_anti"), "undeclared component", F.concat_ws(" > ", "driver", "component")),
        named(repeated(drivers, ["kpi", "driver", "component"]), "driver declared twice", F.concat_ws(" > ", "driver", "component")),
        named(acting.filter("home IS NULL"), "unknown mediator", path),
        named(acting.filter("home <> component"), "mediator explains another component", path)])


def contract_violations(kpis: DataFrame, components: DataFrame, drivers: DataFrame) -> DataFrame:
    """(kpi, rule, subject, n): every broken rule, once for each subject, with the number of declarations that break it."""
    found = shape_violations(kpis, components).unionByName(driver_violations(components, drivers))
    return found.groupBy(*KEYS).agg(F.count("*").alias("n"))
