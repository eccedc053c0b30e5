"""Small document tables with the hard cases: nulls, empty, very long and repeated texts, clashing columns."""

from __future__ import annotations

import random
import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # names that operators use inside must not clash with what a table carries
          "key long, z binary, kept boolean, n_words long, component string, salt int, host string, start int, at int, hot boolean, "
          "block int, epoch int, changed boolean, kept_text string, feature long, path string, license string, fold int, span long, digest string")
SPACE = "[^\x20\x09-\x0D]+"
ALNUM = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def frame(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    width = len(SCHEMA.split(","))
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *[None] * (width - 5)) for r in rows], SCHEMA)


def lower(text: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text: str | None, pattern: str = SPACE) -> list[str]:
    return re.findall(pattern, text or "")


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Random documents with copies, near copies, shared passages and the hard cases."""
    rng = random.Random(seed)
    vocabulary = [f"w{rng.randrange(400)}" for _ in range(300)] + ["Édith", "straße", "Of", "the"]
    shared = " ".join(rng.choices(vocabulary, k=60))

    def text(k: int) -> str:
        return " ".join(rng.choices(vocabulary, k=k))
    rows = [(None if False else i, text(rng.choice([1, 3, 8, 40, 120])), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    base = text(200)
    rows += [(n, base, "en", "a"), (n + 1, base, "en", "a"), (n + 2, base.replace(" ", "\n\t"), "en", "b")]
    for k in range(8):
        w = base.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
        rows.append((n + 3 + k, " ".join(w), "en", "b"))
    rows += [(n + 20 + k, text(30) + " " + shared + "\n" + text(20), "fr", "c") for k in range(6)]
    rows += [(n + 30, None, None, None), (n + 31, "", "en", "a"), (n + 32, " \t\n ", "en", "a"), (n + 33, "solo", "en", "a"), (n + 34, "solo", "en", "a"),
             (n + 35, "x " * 90, "en", "a"), (n + 36, text(30000), "en", "a"), (n + 37, "1 2 3 4 5", "en", "a"), (n + 38, "«–» ..", "fr", "b"),
             (n + 39, "same line here\n" * 12, "en", "b"), (n + 40, text(40) + " " + text(5), "en", "b")]
    return rows
