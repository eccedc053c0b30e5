import random
import re
from collections import Counter, defaultdict

import pytest

from causeway.llm import phrases
from tests.llm.rows import frame, lower


def slow(rows, min_count, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < min_count:
            continue
        longer = [f[lang, q] for (other, q) in f if other == lang and len(q) > len(p) and f[lang, q] >= min_count
                  and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * x >= 80 * a for x in longer):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, them in found.items() for k, (s, a, p, l, r) in enumerate(sorted(them)[:top], 1))


def text_rows(seed=3, n=200):
    rng = random.Random(seed)
    vocabulary = ["Of", "the", "a\x01", "a", "straße", "ab", "b", "Éa", "-", "a-b"] + [f"w{k}" for k in range(6)]
    fixed = ["new york city hall", "of the order", "a b a b a"]
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        rows.append((i, "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \r\n "]) for p in parts), rng.choice(["en", "en", "fr", None]), "a"))
    return rows + [(n, None, "en", "a"), (n + 1, "", "de", "a"), (n + 2, " .,\n", None, "a"), (None, "of the order " * 20, "fr", None), (3, rows[3][1], "en", "a")]


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("partitions, max_bits", [(None, phrases.MAX_BITS), (9, phrases.MAX_BITS), (40, 12)])
def test_phrases_match_brute_force(spark, partitions, max_bits):
    rows = text_rows()
    want = slow(rows, 5)
    assert len(want) > 60 and len({r[0] for r in want}) == 3
    assert got(phrases.collocations(frame(spark, rows), min_count=5, partitions=partitions, max_bits=max_bits)) == want


def test_chunks_of_few_bytes_and_a_short_report(spark, monkeypatch):
    monkeypatch.setattr(phrases, "COUNT_BYTES", 64)
    rows = text_rows(8)
    assert got(phrases.collocations(frame(spark, rows).repartition(3), min_count=4, top=7)) == slow(rows, 4, 7)


def test_empty_table_long_text_and_ties(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [(1, None, "en", "a"), (2, "one two", "en", "a")])).collect() == []
    rows = [(1, "x y. " * 40_000 + "y z. " * 40_000, "en", "a"), (1, "p q. r s. " * 30, "en", "a")]
    assert got(phrases.collocations(frame(spark, rows))) == slow(rows, 30)


def test_lockstep_carries_prefixes_over_partitions(spark):
    grams = [("en", ["a"], 90), ("en", ["a", "b"], 80), ("en", ["a", "b", "c"], 70), ("en", ["a", "b", "c", "d"], 60), ("en", ["a", "c"], 85), ("fr", ["a"], 9)]
    stream = spark.createDataFrame(grams, "lang string, path array<string>, f long")
    rows = {(r["lang"], " ".join(r["path"])): (r["parts"], r["widest"]) for r in phrases.lockstep(stream, 6).collect()}
    assert rows["en", "a b c d"] == ([90, 80, 70], None)
    assert rows["en", "a c"] == ([90, None, None], None)
    assert rows["en", "a"] == ([None] * 3, 85) and rows["en", "a b"] == ([90, None, None], 70) and rows["fr", "a"] == ([None] * 3, None)
