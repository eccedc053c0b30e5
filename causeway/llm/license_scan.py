"""Licence detection by TF-IDF cosine to templates, and inheritance from the nearest directory above.

Headers. Every line of a document's whole text that speaks of a licence is a header. Headers and notices
are vectors of term counts times inverse document frequency (counted over all headers of the corpus and
the notices); a header takes the notice of greatest cosine, if that reaches ``min_cosine``. A notice
may stand inside a longer line: every stretch of a header that has as many terms as some notice and
touches a word on licences is compared too, and counts from ``min_window`` on.

Licence files. Each distinct text that speaks of a licence is a vector over all its words, compared
with whole licence texts; inverse document frequency is counted over these texts and the templates,
and a word of no template weighs like one that no text has. From ``min_text`` on the document is a
file of that licence. So is one most of whose words are licence headers.

A document's own licence is that of its whole text, or else of its best header, the earlier template in
the list where two tie. A licence file licenses its directory. A document without a licence of its own
takes that of the nearest directory above its path that has a licence file; of several in one directory
the smallest document id decides.

DataFrame expressions only. Null and empty texts have no header; a null path has no directory above
but the root, "". Repeated rows give equal rows; an empty table gives an empty result; other columns
are left out.
"""

from __future__ import annotations

import math
import re
from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.quality_rules import words
from causeway.session import write_layer

#: Licence identifiers with the usual wording of short notices.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-or-later",
                "GNU General Public License Version 3, 29 June 2007"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "MPL-2.0": ["This file is subject to the terms of the Mozilla Public License, Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Licensed under the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["Released into the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
}
HEADER = r"(?i)licen[cs]e|spdx|creative commons|public domain|permission is hereby|redistribution and use|cc[ -]by|cc0"
#: Where, in terms joined by a space, a stretch that may be a notice is looked for.
ANCHOR = r"^[a-z0-9]*licen[cs]e|^spdx|^creative commons|^public domain|^permission is hereby|^redistribution and use|^cc by|^cc0"
#: What a text holds that may be a whole licence; its words may be parted by line ends.
SPEAKS = (r"(?i)licen[cs]e|spdx|creative\s+commons|public\s+domain|permission\s+is\s+hereby|permission\s+to\s+use|redistribution\s+and\s+use|"
          r"without\s+warrant|as\s+is\b|cc[\s-]by|cc0")
#: Whole licence texts in ``licences/``, in the order that decides ties. Those that no notice names keep their near kin apart.
WHOLE = ("Apache-2.0", "MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0",
         "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0")
TERM = r"[a-z0-9]+"
SALTS = 16


@cache
def licence_texts() -> dict[str, str]:
    folder = files("causeway.llm") / "licences"
    return {name: (folder / f"{name}.txt").read_text(encoding="utf-8") for name in WHOLE}


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def headers(docs: DataFrame) -> DataFrame:
    """(doc_id, header, n_words): the licence lines of each document, and its number of words."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(HEADER))
    return (docs.where(F.col("text").rlike(HEADER))
            .select("doc_id", F.size(words(F.col("text"))).alias("n_words"), F.explode(F.array_distinct(lines)).alias("header")))


def template_lines(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    rows = [(k, name, line) for k, (name, lines) in enumerate(templates.items()) for line in lines]
    return spark.createDataFrame(rows, "rank int, license string, header string").select(
        "rank", "license", "header", F.xxhash64("header").alias("line"))


def stretches(t: Column, lengths: list[int]) -> Column:
    """Parts of a header, given as the column of its terms, that have as many terms as one of ``lengths``, fewer than it has, and hold or begin an anchor."""
    n = F.size(t)
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda p: F.array_join(F.slice(t, p, F.lit(3)), " ").rlike(ANCHOR))

    def around(p: Column) -> Column:
        def of(w: int) -> Column:
            starts = F.sequence(F.greatest(p - (w - 1), F.lit(1)), F.greatest(F.least(p, n - (w - 1)), F.lit(1)))
            return F.when(n > w, F.transform(starts, lambda k: F.array_join(F.slice(t, k, F.lit(w)), " "))).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.array(*[of(w) for w in lengths]))
    return F.array_distinct(F.flatten(F.transform(at, around)))


def classified(found: DataFrame, templates: DataFrame, lengths: list[int], min_cosine: float, min_window: float) -> DataFrame:
    """(header, rank, license, cosine, n_header): the best template of each distinct header, where one is near enough; words that it covers."""
    distinct = found.groupBy("header").agg(F.count(F.lit(1)).alias("copies"))
    # the terms are stored, as a lambda would make them anew at every place
    distinct = write_layer(distinct.withColumn("terms", terms(F.col("header"))), "license-distinct")
    seen = (distinct.select("header", F.col("copies").cast("double").alias("copies"), F.lit("corpus").alias("origin"))
            .unionByName(templates.select("header", F.lit(1.0).alias("copies"), F.lit("template").alias("origin"))))
    counted = seen.select("header", "copies", "origin", F.explode(F.array_distinct(terms(F.col("header")))).alias("term"))
    total = seen.agg(F.coalesce(F.sum("copies"), F.lit(0.0)).alias("n")).first()["n"]
    idf = counted.groupBy("term").agg((F.log(F.lit(1.0 + total) / (1 + F.sum("copies"))) + 1).alias("idf"))
    idf = write_layer(idf, "license-idf")
    parts = (distinct.select("header", F.explode(stretches(F.col("terms"), lengths)).alias("piece")).withColumn("part", F.lit(True))
             .unionByName(distinct.select("header", F.col("header").alias("piece"), F.lit(False).alias("part"))))
    parts = write_layer(parts, "license-pieces")

    def vectors(rows: DataFrame) -> DataFrame:
        tf = rows.select("header", F.explode(terms(F.col("header"))).alias("term")).groupBy("header", "term").agg(F.count(F.lit(1)).alias("tf"))
        return tf.join(idf, "term").select("header", "term", (F.col("tf") * F.col("idf")).alias("weight"))
    mine = vectors(parts.select(F.col("piece").alias("header")).distinct())
    theirs = vectors(templates.select("header").distinct()).withColumnRenamed("header", "template")
    norm = mine.groupBy("header").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    other = theirs.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("other"))
    dots = (mine.join(theirs.withColumnRenamed("weight", "w"), "term").groupBy("header", "template").agg(F.sum(F.col("weight") * F.col("w")).alias("dot"))
            .join(norm, "header").join(other, "template").select("header", "template", F.round(F.col("dot") / (F.col("norm") * F.col("other")), 6).alias("cosine")))
    near = dots.where(F.col("cosine") >= min(min_cosine, min_window)).join(templates.select(F.col("header").alias("template"), "rank", "license"), "template")
    best = near.groupBy("header").agg(F.max(F.struct("cosine", (-F.col("rank")).alias("order"), "license")).alias("b"))
    best = best.select(F.col("header").alias("piece"), "b.cosine", "b.order", "b.license")
    # whole headers win ties: their words count towards a licence file
    of = (parts.join(best, "piece").where(F.col("cosine") >= F.when(F.col("part"), min_window).otherwise(min_cosine))
          .groupBy("header").agg(F.max(F.struct("cosine", "order", (~F.col("part")).alias("entire"), "license", F.size(words(F.col("piece"))).alias("n"))).alias("b")))
    return of.select("header", (-F.col("b.order")).alias("rank"), "b.license", "b.cosine", F.col("b.n").alias("n_header"))


def whole(rows: DataFrame, texts: dict[str, str], min_text: float) -> DataFrame:
    """(doc_id, text_license, text_cosine): documents whose whole text is near a licence text. ``rows``: (doc_id, text)."""
    spark, names = rows.sparkSession, list(texts)
    key = [F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")]
    spoken = rows.where(F.col("text").rlike(SPEAKS)).select("doc_id", *key, "text")
    # a text with copies has all its counts times their number, which no cosine sees
    tf = (spoken.select("a", "b", F.explode(terms(F.col("text"))).alias("term")).groupBy("a", "b", "term").agg(F.count(F.lit(1)).cast("double").alias("tf")))
    tf = write_layer(tf, "license-text-terms")
    given = spark.createDataFrame([(k, texts[name]) for k, name in enumerate(names)], "k int, text string")
    given = given.select("k", F.explode(terms(F.col("text"))).alias("term")).groupBy("term", "k").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    given = write_layer(given, "license-texts")
    total = float(tf.select("a", "b").distinct().count() + len(names))
    known = given.groupBy("term").agg(F.count(F.lit(1)).alias("own"), F.map_from_entries(F.collect_list(F.struct("k", "tf"))).alias("at"))
    # a few thousand words of the templates, whatever the corpus
    df = tf.join(F.broadcast(known.select("term")), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = known.join(df, "term", "left").select("term", "at", (F.log(F.lit(1.0 + total) / (1 + F.col("own") + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    known = write_layer(known, "license-text-idf")
    norms = {r["k"]: r["s"] ** 0.5 for r in known.select("idf", F.explode("at").alias("k", "tf")).groupBy("k").agg(F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).alias("s")).collect()}
    idf, unseen = F.col("idf"), math.log(1.0 + total) + 1
    weighed = tf.join(F.broadcast(known), "term", "left")
    dots = weighed.groupBy("a", "b").agg(F.sum(F.pow(F.col("tf") * F.coalesce(idf, F.lit(unseen)), 2)).alias("s"),
                                         *[F.sum(F.col("tf") * idf * idf * F.coalesce(F.col("at")[k], F.lit(0.0))).alias(f"k{k}") for k in norms])
    scores = F.array(*[F.struct(F.round(F.coalesce(f"k{k}", F.lit(0.0)) / (F.sqrt("s") * norms[k]), 6).alias("cosine"), F.lit(-k).alias("order"),
                                F.lit(names[k]).alias("license")) for k in norms])
    near = dots.select("a", "b", F.array_max(scores).alias("t")).where(F.col("t.cosine") >= min_text)
    near = write_layer(near.select("a", "b", "t.license", "t.cosine"), "license-text-classes")
    # a licence's text may be a large part of all documents: its row is repeated over salts
    spread = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (spoken.drop("text").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(spread, ["a", "b", "salt"])
            .groupBy("doc_id").agg(F.max(F.struct("cosine", "license")).alias("t")).select("doc_id", F.col("t.license").alias("text_license"), F.col("t.cosine").alias("text_cosine")))


def ancestors(path: Column) -> Column:
    """The directories above a path, "" (the root) first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None,
         min_cosine: float = 0.6, file_share: float = 0.5, texts: dict[str, str] | None = None, min_text: float = 0.8, min_window: float = 0.85) -> DataFrame:
    """One row per document: (doc_id, license, origin, cosine, license_dir).

    ``templates``: notices by licence; ``texts``: whole texts by licence.
    ``origin``: own, inherited or none; ``cosine``: that of the own licence; ``license_dir``: the
    directory that gave an inherited one.
    """
    # rows go by id and a digest of the text: rows without an id and texts that share one stay apart
    name = F.struct(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    rows = docs.select(name.alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"), F.col(text_col).alias("text"))
    found = write_layer(headers(rows), "license-headers")
    notices = templates or TEMPLATES
    lengths = sorted({len(re.findall(TERM, line.lower())) for lines in notices.values() for line in lines})
    known = write_layer(classified(found, template_lines(docs.sparkSession, notices), lengths, min_cosine, min_window), "license-classes")
    # a notice may stand in a third of all documents: the few distinct headers are repeated over salts
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = found.dropDuplicates(["doc_id", "header"]).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(spread, ["header", "salt"])
    own = (hits.groupBy("doc_id").agg(F.max(F.struct("cosine", (-F.col("rank")).alias("order"), "license")).alias("b"),
                                      (F.sum("n_header") >= file_share * F.max("n_words")).alias("file"))
           .select("doc_id", "b.license", "b.cosine", "file"))
    entire = whole(rows.select("doc_id", "text"), licence_texts() if texts is None else texts, min_text)
    is_text = F.col("text_license").isNotNull()
    own = own.join(entire, "doc_id", "full").select(
        "doc_id", F.coalesce("text_license", "license").alias("license"), F.coalesce("text_cosine", "cosine").alias("cosine"), (is_text | F.col("file")).alias("file"))
    own = write_layer(own, "license-own")
    placed = rows.select("doc_id", "path").join(own, "doc_id", "left")
    parent = F.expr("array_join(slice(split(path, '/'), 1, size(split(path, '/')) - 1), '/')")
    directories = (placed.where("file").groupBy(parent.alias("dir")).agg(F.min(F.struct("doc_id", "license")).alias("f"))
                   .select("dir", F.col("f.license").alias("dir_license"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    above = (placed.where("license IS NULL").select("path").distinct()
             .select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "dir"), F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt")))
    nearest = (above.join(directories, ["dir", "salt"]).groupBy("path").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("n"))
               .select("path", F.col("n.dir").alias("license_dir"), F.col("n.dir_license").alias("dir_license")))
    inherited = F.col("license").isNull() & F.col("dir_license").isNotNull()
    return (placed.join(nearest, "path", "left")
            .select(F.col("doc_id.id").alias("doc_id"), F.coalesce("license", "dir_license").alias("license"),
                    F.when(F.col("license").isNotNull(), "own").when(inherited, "inherited").otherwise("none").alias("origin"),
                    "cosine", F.when(inherited, F.col("license_dir")).alias("license_dir")))
