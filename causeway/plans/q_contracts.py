"""Queries over contracts kept as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators import contract_rules as R
from causeway.plans.catalog import query
from causeway.plans.workspace import Workspace


def choice(index, words: dict[int, str], other: str):
    """The word of an index, else ``other``."""
    picked = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.coalesce(F.try_element_at(picked, index.cast("int")), F.lit(other))


@query
def contract_violations(w: Workspace) -> DataFrame:
    """Parts as declarations of contracts, some sound and many broken: fifty part keys of one brand make a KPI."""
    key, size = F.col("p_partkey"), F.col("p_size")
    block = F.floor(key / 50).cast("bigint")
    kind = block % 4
    rows = w.facts.table("part").select(
        F.concat_ws("/", "p_brand", block.cast("string")).alias("kpi"),
        choice(kind, {0: "k = a * b", 1: "k = a / b", 2: "k"}, "k = a * b / c").alias("formula"),
        F.concat(F.lit("c"), (key % 4).cast("string")).alias("component"), F.concat(F.lit("d"), (key % 7).cast("string")).alias("driver"),
        key.alias("ordinal"), (size - 4).alias("max_lag"), (size % 11).alias("cadence"),
        choice(size % 5, {0: "Direct ", 1: "upstream", 2: "context", 3: "response"}, "leader").alias("causal_role"),
        F.when(key % 3 == 0, F.concat(F.lit("d"), (size % 9).cast("string"))).otherwise(" ").alias("mediates_through"),
        choice(key % 6, {0: "up", 1: "positive", 2: "negative"}, "unknown").alias("expected_effect_sign"),
        (size % 3 == 0).alias("is_component"))
    return R.contract_violations(rows.select("kpi", "formula").distinct(), rows.filter("is_component").select("kpi", "component"),
                                 rows.filter("NOT is_component"))
