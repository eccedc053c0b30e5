"""From raw documents to a training order: five stages, each written before the next reads it.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``; ``n_chars``
follows the text where a stage changes it. Null texts, repeated rows and empty tables are handled as
the operators' docstrings say. Rows go by id and text: of an id with two texts each is judged on its own,
and repeated rows share a verdict. Other columns that the documents carry are kept until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import decontamination, mixing, near_dedup, quality_rules, substring_dedup
from causeway.llm.queries import prepared, table
from causeway.session import write_layer


def named(docs: DataFrame) -> DataFrame:
    """(row, doc): whole rows, and what they go by: texts that share an id stay apart, copies of a row do not."""
    digest = F.coalesce(F.md5("text"), F.lit("-"))
    return docs.select(F.struct(F.col("doc_id").alias("id"), digest.alias("digest")).alias("row"), F.struct("*").alias("doc"))


def only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents of ``rows`` whose name is in ``kept`` (row)."""
    return rows.join(kept.distinct(), "row", "left_semi").select("doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules and whose host passes; rows without an id go."""
    prepared(spark)
    rows = named(docs.where("doc_id IS NOT NULL"))
    judged = quality_rules.judge(rows.select("row", "doc.text", "doc.source"), id_col="row")
    return only(rows, judged.where("kept").select(F.col("doc_id").alias("row")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest id (then smallest digest), and it once."""
    prepared(spark)
    rows = named(docs)
    found = near_dedup.near_duplicates(rows.select("row", "doc.text"), id_col="row")
    return only(rows.dropDuplicates(["row"]), found.where("kept").select(F.col("doc_id").alias("row")))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand elsewhere too; documents of which nothing remains go."""
    prepared(spark)
    rows = named(docs)
    cut = write_layer(substring_dedup.dedup(rows.select("row", "doc.text"), id_col="row", with_text=True).where("n_removed > 0"), "pipeline-cut")
    cut = (cut.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("row"), F.struct((F.col("n_removed") < F.col("n_words")).alias("remains"), "kept_text").alias("cut")))
    changed = F.col("cut").isNotNull()
    new = {"text": F.col("cut.kept_text"), "n_chars": F.length("cut.kept_text")}
    return rows.join(cut, "row", "left").where("cut IS NULL OR cut.remains").select(
        *[F.when(changed, new[c].cast(docs.schema[c].dataType)).otherwise(F.col(f"doc.{c}")).alias(c) if c in new else F.col(f"doc.{c}").alias(c) for c in docs.columns])


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    prepared(spark)
    rows = named(docs)
    found = decontamination.matches(rows.select("row", "doc.text"), table(spark, sf_dir, "benchmark"), id_col="row")
    return only(rows, found.where(F.size("start") == 0).select(F.col("doc_id").alias("row")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The order in which documents are read, each at least once."""
    prepared(spark)
    return mixing.mix(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("substring dedup", substrings),
          ("benchmark decontamination", benchmarks), ("source mixing", mixture)]

#: The mixing exponent is found by section search, which SQL cannot express; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_layer(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
