"""Evidence retrieval from a corpus table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.functions import text as T

# Fixed value: how many sources a search keeps.
SOURCES = 5


def page_corpus(pages: DataFrame) -> DataFrame:
    """(doc_id, source_url, title, body) from raw pages."""
    return pages.select(F.col("page_id").alias("doc_id"), T.canonical_url("url").alias("source_url"),
                        T.page_title("html").alias("title"), T.visible_text("html").alias("body"))


def searches(queries: DataFrame) -> DataFrame:
    """Distinct searches: (search, terms, anchor_words). A search without an anchor word asks for any of its terms."""
    return queries.select(F.col("query").alias("search"), "anchor").distinct() \
        .withColumn("terms", T.words("search")).withColumn("anchor_words", F.coalesce(T.words("anchor"), F.array().cast("array<string>")))


def rank_within(column: str, *order) -> Column:
    return F.row_number().over(W.partitionBy(*column.split()).orderBy(*order))


def shortlist(rows: DataFrame, group: str, keep: int, *order) -> DataFrame:
    """The sources of a group that a walk in the given order can keep, when others may have been kept before.

    ``keep`` - 1 kept sources block as many URLs and titles. Of equal (URL, title) pairs only the
    first counts; then a source is out of reach if ``keep`` sources of its URL, or of its title, come
    before it, or so many others that not all of them can be blocked.
    """
    own = F.col("doc_id").cast("string")
    named = rows.withColumn("_k", F.when(F.col("tk") == "", own).otherwise(F.col("tk"))).withColumn("_l", F.coalesce("source_url", own))
    few = named.withColumn("_r", rank_within(f"{group} _l _k", *order)).filter("_r = 1")
    for part in ("_l", "_k"):
        few = few.withColumn("_r", rank_within(f"{group} {part}", *order))
        few = few.withColumn(f"_ok{part}", F.col("_r") <= keep)
    reach = 2 * keep * (keep - 1) + keep
    few = few.filter("_ok_l AND _ok_k").withColumn("_r", rank_within(group, *order)).filter(F.col("_r") <= reach)
    return few.drop("_r", "_l", "_k", "_ok_l", "_ok_k")


def search(corpus: DataFrame, queries: DataFrame, keep: int = SOURCES) -> DataFrame:
    """Best sources per distinct search: (search, search_rank, doc_id, source_url, title, body).

    A source must contain every word of the anchor (of a search without one: any of its words); it is
    ranked by the number of query words it contains, and dropped if its URL or title was kept before.

    Sources are grouped by the set of search words they contain. A set keeps the sources that any
    search could take from it, a number that does not grow with the corpus, and searches meet sets
    instead of sources, by an equi join on a word. The texts are fetched last, for the kept sources.
    """
    asked = searches(queries)
    vocabulary = asked.select(F.explode(F.concat("terms", "anchor_words")).alias("word")).distinct()
    found = corpus.select("doc_id", F.explode(T.words(F.concat_ws(" ", "title", "body"))).alias("word")) \
        .join(vocabulary, "word", "left_semi")
    per_doc = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("word")).alias("has"))
    heads = corpus.select("doc_id", "source_url", "title", T.title_key("title").alias("tk")).join(per_doc, "doc_id") \
        .withColumn("set", F.md5(F.array_join("has", " ")))
    sets = shortlist(heads, "set", keep, "doc_id")
    key = F.when(F.size("anchor_words") > 0, F.slice("anchor_words", 1, 1)).otherwise(F.col("terms"))
    met = (
        sets.groupBy("set").agg(F.first("has").alias("has")).withColumn("key", F.explode("has"))
        .join(asked.withColumn("key", F.explode(key)), "key")
        .filter(F.size(F.array_except("anchor_words", "has")) == 0)
        .select("search", "set", F.size(F.array_intersect("terms", "has")).alias("score")).distinct()
    )
    top = shortlist(met.join(sets.drop("has"), "set"), "search", keep, F.desc("score"), "doc_id")
    kept = without_repeats(top, keep)
    return kept.join(corpus.select("doc_id", "body"), "doc_id")


def without_repeats(heads: DataFrame, keep: int) -> DataFrame:
    """Walk each search's short list in rank order and drop a source whose URL or title was already kept."""
    cell = F.struct((-F.col("score")).alias("order"), "doc_id", "source_url", "title", "tk")
    lists = heads.groupBy("search").agg(F.sort_array(F.collect_list(cell)).alias("raw"))

    def step(kept: Column, r: Column) -> Column:
        seen = F.exists(kept, lambda k: F.coalesce(k["source_url"] == r["source_url"], F.lit(False))
                        | ((r["tk"] != "") & (k["tk"] == r["tk"])))
        return F.when(seen, kept).otherwise(F.concat(kept, F.array(r)))
    kept = F.slice(F.aggregate("raw", F.slice("raw", 1, 0), step), 1, keep)
    return lists.select("search", F.posexplode(kept).alias("i", "r")).select(
        "search", (F.col("i") + 1).alias("search_rank"), "r.doc_id", "r.source_url", "r.title")
