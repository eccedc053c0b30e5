"""Host-level quality rules: per-document measures, failure rates of hosts, verdicts joined back.

Each document is measured on its whole text. The failures of a host are pooled, and its rate is
shrunk towards the rates of all hosts by a beta prior fitted to them by moments, so that a host of
few documents is not judged on chance. A document is kept if it passes its own rules and its host's
shrunk rate stays within the limit.

DataFrame expressions only. A null or empty text has no words and fails. A null host is a host of
its own. Repeated rows count as often as they occur; an empty table gives an empty result; other
columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.session import write_layer

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
SALTS = 64
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it many times."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def covered(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, from the hashes in text order."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(p: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            other = F.get(p, k)
            return F.coalesce(other["h"] == x["h"], F.lit(False))
        twice = F.filter(p, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def total(q: Column) -> Column:
        steps = F.transform(q, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(q, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return bind(bind(pairs, positions), total)


def repeat_words(w: Column) -> Column:
    none = F.lit(0).cast("long")
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                         lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))
    counted = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))
    return F.when(F.size(w) > WINDOW, counted).otherwise(none)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with their measures, from whole texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, SPACE_CHARS, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    of_words = bind(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    of_lines = bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return (docs.withColumn("_w", of_words)
            .withColumns({"n_words": F.col("_w.n"), "word_chars": F.length(bare).cast("long"),
                          "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
                          "n_dup_lines": of_lines.cast("long"), "n_repeat_words": F.col("_w.r")})
            .drop("_w"))


def base_failed(min_words: int = 10, repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def host_rates(failures: DataFrame) -> DataFrame:
    """(host, n, failed, rate): failure rates shrunk by a beta prior.

    The prior's mean is the mean rate of the hosts, its strength comes from the variance between
    hosts less what counting alone would give, but is at least ``10`` documents; hosts that differ by no more share the
    strongest prior, ``1000`` documents. ``failures``: rows (host, failed).
    """
    hosts = write_layer(failures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failed")), "quality-hosts")
    raw = F.col("failed") / F.col("n")
    seen = hosts.agg(F.avg(raw).alias("m"), F.avg(raw * raw).alias("m2"), F.avg(1 / F.col("n")).alias("inverse")).first()
    mean, strength = seen["m"] or 0.0, 1000.0
    if seen["inverse"] is not None and seen["inverse"] < 1:
        chance = mean * (1 - mean)
        between = (seen["m2"] - mean * mean - chance * seen["inverse"]) / (1 - seen["inverse"])
        if between > 1e-12:
            strength = min(1000.0, max(chance / between - 1, 10.0))
    rate = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("host", "n", "failed", rate.alias("rate"))


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
          min_words: int = 10, repeat_percent: int = 20, max_rate: float = 0.5) -> DataFrame:
    """One row per document: its measures, ``base_failed``, ``host_rejected`` and ``kept``.

    The measures are written once and read by the pooling and by the join. The host table is
    repeated over ``SALTS`` so that a host with a third of all rows spreads over many tasks.
    """
    rows = write_layer(
        measured(docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text")))
        .select("doc_id", "host", *MEASURES, base_failed(min_words, repeat_percent).alias("base_failed")), "quality-measures")
    named = rows.withColumns({"no_host": F.col("host").isNull(), "host": F.coalesce(F.col("host").cast("string"), F.lit(""))})
    pooled = named.select(F.struct("no_host", "host").alias("host"), F.col("base_failed").alias("failed"))
    verdicts = (host_rates(pooled).select("host.*", (F.col("rate") > max_rate).alias("host_rejected"))
                .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return (salted.join(verdicts, ["no_host", "host", "salt"])
            .select("doc_id", *MEASURES, "base_failed", "host_rejected",
                    (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept")))
