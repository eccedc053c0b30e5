"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share raised to an exponent and normalised. The exponent is found by
section search (bisection with many points at once, each round one small aggregation): the smallest
one in [0, 1] at which no source is read more than ``max_epochs`` times and the weights' entropy is
no more than ``evenness`` of the greatest possible. Where none is, as the shares are too even already, the
exponent is 1 (the shares as they are: a larger one would leave documents out), and ``mix`` warns, or raises
with ``unmet="error"``. The token budget is such that the source with
the least repetition is read exactly once, so no document is lost; the others are repeated.

A source is cut into blocks by a hash of the document id. Each epoch reads the blocks in a new
order, and each block's documents in a new order. The last epoch ends where the budget does: whole
blocks first, then the documents of one block that still fit.

A null or empty text has no tokens and is read with its block. A null source is a source of its own;
a source without tokens is read once. Repeated rows are separate documents of equal rank. An empty
table gives an empty mixture; other columns of the input are left out.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.quality_rules import words
from causeway.session import write_layer

POINTS = 32
ROUNDS = 6


def solve_exponent(totals: DataFrame, evenness: float, max_epochs: float) -> float:
    """Smallest exponent in [0, 1] that keeps both limits; ``totals``: (tokens) per source."""
    positive = totals.where(F.col("tokens") > 0).select(F.col("tokens").cast("double").alias("n"))
    seen = positive.agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.count(F.lit(1)).alias("sources")).first()
    if seen["sources"] < 2:
        return 1.0
    limit = evenness * math.log(seen["sources"])
    share = F.col("n") / F.lit(seen["all"])
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / POINTS
        grid = F.transform(F.sequence(F.lit(0), F.lit(POINTS)), lambda i: F.lit(low) + i * F.lit(step))
        power = F.pow(share, F.col("a"))
        found = (positive.withColumn("a", F.explode(grid)).groupBy("a")
                 .agg(F.sum(power).alias("z"), F.sum(power * F.log(share)).alias("s"),
                      F.max(F.pow(F.col("n") / F.lit(seen["most"]), F.col("a") - 1)).alias("epochs"))
                 .orderBy("a").collect())
        fits = [r["a"] for r in found if r["epochs"] <= max_epochs + 1e-9
                and math.log(r["z"]) - r["a"] * r["s"] / r["z"] <= limit + 1e-12]
        if not fits:
            return 1.0
        high = fits[0]
        low = max(low, high - step)
        if high == low:
            break
    return round(high, 6)


def target_met(totals: DataFrame, exponent: float, evenness: float, max_epochs: float) -> bool:
    """Whether both limits hold at an exponent (to rounding); with fewer than two sources that have tokens they do."""
    positive = totals.where(F.col("tokens") > 0).select(F.pow(F.col("tokens").cast("double"), F.lit(exponent)).alias("w"), F.col("tokens").cast("double").alias("n"))
    seen = positive.agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("s"), F.max("n").alias("most"), F.min("n").alias("least"), F.count(F.lit(1)).alias("sources")).first()
    if seen["sources"] < 2:
        return True
    entropy = math.log(seen["z"]) - seen["s"] / seen["z"]
    repeated = (seen["least"] / seen["most"]) ** (exponent - 1)
    return entropy <= evenness * math.log(seen["sources"]) + 1e-5 and repeated <= max_epochs + 1e-4


def plan_weights(totals: DataFrame, exponent: float) -> DataFrame:
    """Adds weight, budget, whole epochs and the tokens left for the last, partial one."""
    n = F.col("tokens").cast("double")
    seen = totals.agg(F.max(n).alias("most"), F.sum(F.when(n > 0, F.pow(n, F.lit(exponent)))).alias("z")).first()
    most, z = float(seen["most"] or 0), float(seen["z"] or 1)
    budget = F.when(n > 0, F.round(F.lit(most) * F.pow(n / F.lit(most or 1.0), F.lit(exponent))).cast("long")).otherwise(F.lit(0))
    return (totals.withColumns({"weight": F.when(n > 0, F.pow(n, F.lit(exponent)) / z).otherwise(0.0), "budget": budget})
            .withColumns({"epochs": F.expr("CASE WHEN tokens > 0 THEN budget DIV tokens ELSE 1 END"),
                          "rest": F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END")}))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
        evenness: float = 0.98, max_epochs: float = 4.0, block_docs: int = 1000, seed: int = 17, unmet: str = "warn") -> DataFrame:
    """The training order: (doc_id, source, epoch, block_rank, doc_rank, n_tokens).

    ``epoch``, ``block_rank`` and ``doc_rank`` order the rows of a source. A block holds about
    ``block_docs`` documents, or the root of the source's size if that is more, so that neither the
    blocks of a source nor the documents of a block outgrow a task.
    """
    n_tokens = F.size(words(F.coalesce(F.col(text_col), F.lit("")))).cast("long")
    rows = write_layer(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_tokens.alias("n_tokens")),
                       "mix-tokens")
    totals = write_layer(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-totals")
    exponent = solve_exponent(totals, evenness, max_epochs)
    if not target_met(totals, exponent, evenness, max_epochs):
        problem = f"no exponent up to 1 reaches an evenness of {evenness} with at most {max_epochs} epochs; sources keep the weights of exponent {exponent}"
        if unmet == "error":
            raise ValueError(problem)
        warnings.warn(problem, stacklevel=2)
    plan = plan_weights(totals, exponent)
    plan = plan.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("docs") / F.greatest(F.lit(float(block_docs)), F.sqrt("docs")))).cast("long"))

    # how many blocks a source has must be known where its documents are: salted, as a source may be a third of all rows
    salts = 64
    sizes = plan.select(F.col("source").alias("s"), "blocks", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    placed = (salted.join(sizes, salted["source"].eqNullSafe(sizes["s"]) & (salted["salt"] == sizes["salt"]))
              .select("doc_id", "source", "n_tokens", F.expr(f"pmod(xxhash64(doc_id, {seed}), blocks)").alias("block")))

    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    epochs = plan.select(F.col("source").alias("s"), "epochs", "rest",
                         F.explode(F.expr("sequence(0L, epochs - IF(rest = 0, 1, 0))")).alias("epoch"))
    reading = (blocks.join(epochs, F.col("source").eqNullSafe(F.col("s"))).drop("s")
               .withColumn("order", F.xxhash64(F.lit(seed), "epoch", "block")))
    order = Window.partitionBy("source", "epoch").orderBy("order", "block")
    reading = (reading.withColumns({"block_rank": F.row_number().over(order), "upto": F.sum("tokens").over(order)})
               .withColumn("room", F.when(F.col("epoch") < F.col("epochs"), F.col("tokens"))
                           .otherwise(F.col("rest") - (F.col("upto") - F.col("tokens"))))
               .where("room > 0 OR epoch < epochs")
               .select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "block_rank", "room", F.col("tokens").alias("block_tokens")))
    within = Window.partitionBy("source", "epoch", "block_rank").orderBy("order", "doc_id")
    read = (placed.join(reading, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
            .withColumn("order", F.xxhash64(F.lit(seed + 1), "epoch", "doc_id"))
            .withColumns({"doc_rank": F.row_number().over(within), "upto": F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0))}))
    return (read.where("room >= block_tokens OR upto <= room")
            .select("doc_id", "source", F.col("epoch").cast("long").alias("epoch"), F.col("block_rank").cast("long").alias("block_rank"),
                    F.col("doc_rank").cast("long").alias("doc_rank"), "n_tokens"))
