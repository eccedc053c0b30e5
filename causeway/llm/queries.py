"""Named queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import decontamination, html_text, language_id, language_model, license_scan, mixing, near_dedup, phrases, quality_rules, simhash, substring_dedup, token_alignment, toxicity
from causeway.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def prepared(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches that stay small where rows are long texts or packed counts."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepared(spark), sf_dir)
    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain low quality, toxic, toxic and of low quality; a document is toxic from the chain's threshold on."""
    categories = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1,
                  "toxic_low_quality": (F.col("toxic") == 1) & (F.col("quality") == 0)}
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), categories)
    threshold = next((link.threshold for link in chain if link.name == "toxic"), 1.0)
    scored = toxicity.score(docs, chain, list(categories))
    return scored.select("doc_id", *[f"p_{c}" for c in categories], F.col("p_toxic").alias("score"), (F.col("p_toxic") >= threshold).alias("toxic"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.summary(found)


@query
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories are sources, with one directory for each language."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    return license_scan.scan(table(spark, sf_dir, "documents"), path)


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


@query
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.correspondences(table(spark, sf_dir, "documents"))


@query
def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
