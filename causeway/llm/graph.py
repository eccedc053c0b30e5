"""Connected components by repeated contraction (a distributed union-find)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.session import write_layer


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); the component is its smallest node.

    Each round joins every node to the neighbour, or itself, that comes first in an order drawn anew
    for the round, and contracts the graph; an expected constant share of the nodes goes each time.
    Each round is written to the shared folder, so a lost executor costs one round. Loops are
    allowed; an empty edge table gives an empty result.
    """
    kind = edges.schema["a"].dataType
    edges = write_layer(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        draw = len(levels)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.min(F.struct(F.xxhash64(F.lit(draw), "b").alias("h"), F.col("b").alias("n"))).alias("near")
        joined = (both.groupBy("a").agg(first)
                  .select(F.col("a").alias("node"), F.least("near", F.struct(F.xxhash64(F.lit(draw), "a").alias("h"), F.col("a").alias("n")))["n"].alias("parent")))
        joined = write_layer(joined, f"{name}-parents-{draw}")
        levels.append(joined)
        left, right = joined.toDF("a", "pa"), joined.toDF("b", "pb")
        moved = edges.join(left, "a").join(right, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        # a node's parent may itself have moved: that edge remains in the contracted graph as (parent, grandparent)
        edges = write_layer(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-{draw}")
    spark = edges.sparkSession
    if not levels:
        return spark.createDataFrame([], "node " + kind.simpleString() + ", component " + kind.simpleString())
    labels = levels[0]
    for upper in levels[1:]:
        labels = (labels.join(upper.toDF("up", "to"), F.col("parent") == F.col("up"), "left")
                  .select("node", F.coalesce("to", "parent").alias("parent")))
    labels = write_layer(labels, f"{name}-labels")
    least = labels.groupBy("parent").agg(F.min("node").alias("component"))
    return labels.join(least, "parent").select("node", "component")
