import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from causeway.llm import near_dedup, substring_dedup
from causeway.llm.graph import components
from causeway.llm.near_dedup import compare, forest, superminhash
from causeway.llm.tokens import U64, mix
from tests.llm.rows import corpus, frame, lower, words

DOCS = corpus()


def shingle_sets(rows):
    out = {}
    for i, text, *_ in rows:
        w = words(lower(text))
        out[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def expected_components(rows):
    sets = shingle_sets(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block_docs", [512, 2])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block_docs):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(near_dedup.verified, "__defaults__", (block_docs, near_dedup.BLOCK_BYTES))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, DOCS)).collect()}
    assert got == expected_components(DOCS)


def test_near_duplicates_repeated_rows_and_empty_table(spark):
    rows = [(5, "a b c d e f g", "en", "a")] * 3 + [(7, "a b c d e f g", "en", "a"), (8, None, None, None)]
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(frame(spark, rows)).collect())
    assert got == [(5, 3, 5, True)] * 3 + [(7, 3, 5, False), (8, 0, 8, True)]
    assert near_dedup.near_duplicates(frame(spark, [])).collect() == []


def reference_signature(elements, slots):
    """One element at a time, with a whole permutation each."""
    best = [float("inf")] * slots
    for e in elements:
        order = list(range(slots))
        for j in range(slots):
            draw = int(mix(np.array([e], U64) + U64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))[0])
            k = j + (draw & 0x7FFFFFFF) % (slots - j)
            order[j], order[k] = order[k], order[j]
            best[order[j]] = min(best[order[j]], (draw >> 11) * 2.0 ** -53 + j)
    return best


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40, unique=True), st.integers(2, 30))
def test_superminhash_early_stop_changes_nothing(elements, slots):
    row = np.zeros(len(elements), np.int64)
    got = superminhash(row, np.array(elements, U64), 1, slots)[0]
    assert got.tolist() == reference_signature(elements, slots)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 1000).astype(U64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(U64)])
    s = superminhash(np.repeat([0, 1], 1000), np.concatenate([a, b]), 2, 240)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.1


def test_compare_counts_shared_shingles():
    row, value = np.array([0, 0, 0, 1, 1, 1, 2]), np.array([1, 2, 3, 1, 2, 3, 9], U64)
    assert forest(compare(row, value, 3, 85)).tolist() == [0, 0, 2]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges, "t").collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert components(edges.where("a < 0"), "t").collect() == []


def expected_cut(rows, window):
    texts = [(i, words(t)) for i, t, *_ in rows]
    count = Counter(tuple(w[k:k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k:k + window])] > 1:
                keep[k:k + window] = [False] * window
        kept = [x for x, y in zip(w, keep) if y]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("pieces", [500, 1])
def test_substrings_match_brute_force(spark, pieces):
    got = sorted(tuple(r) for r in substring_dedup.dedup(frame(spark, DOCS), group_pieces=pieces).collect())
    assert got == expected_cut(DOCS, 35)


def test_substrings_repeated_rows_and_empty_table(spark):
    long = " ".join(f"t{k}" for k in range(40))
    rows = [(1, long, "en", "a")] * 2 + [(2, "short", "en", "a")] * 2
    got = sorted(tuple(r) for r in substring_dedup.dedup(frame(spark, rows)).collect())
    assert got == expected_cut(rows, 35) and [r[2] for r in got] == [40, 40, 0, 0]
    assert substring_dedup.dedup(frame(spark, [])).collect() == []


def test_cut_keeps_white_space_of_what_stays():
    assert substring_dedup.cut(b" a  b\nc d\n", [(1, 2)]) == (b" a  c d\n", 1)


def unnamed_rows():
    """Rows without an id, and an id with two texts."""
    def text(name, n):
        return " ".join(f"{name}{k}" for k in range(n))
    copied, shared = text("c", 50), text("s", 40)
    return [(None, copied, "en", "a"), (5, copied, "en", "a"), (6, copied + " z", "en", "a"), (7, copied, "en", "a"),
            (None, text("n", 20) + " " + shared, "en", "a"), (8, text("m", 20) + " " + shared, "en", "a"),
            (9, text("p", 60), "en", "a"), (9, text("q", 20) + " " + text("r", 60), "en", "a"), (10, text("t", 9) + " " + text("r", 60), "en", "a"),
            (None, "", "en", "a"), (None, text("u", 30), "en", "a")]


def named(rows):
    return [(k, *r[1:]) for k, r in enumerate(rows)]


def test_near_duplicates_of_rows_without_an_id_and_of_an_id_with_two_texts(spark):
    rows = unnamed_rows()
    got = Counter(tuple(r) for r in near_dedup.near_duplicates(frame(spark, rows)).collect())
    of = expected_components(named(rows))
    want = Counter()
    for k, (n, c) in of.items():
        ids = [rows[j][0] for j in of if of[j][1] == c and rows[j][0] is not None]
        least = min(ids, default=None)
        want[(rows[k][0], n, least, rows[k][0] == least)] += 1
    assert got == want and (6, 47, 5, False) in got and (None, 46, 5, False) in got


def test_substrings_of_rows_without_an_id_and_of_an_id_with_two_texts(spark):
    rows = unnamed_rows()
    got = Counter(tuple(r) for r in substring_dedup.dedup(frame(spark, rows)).collect())
    assert got == Counter((rows[k][0], *x) for k, *x in expected_cut(named(rows), 35))
    assert sum(n > 0 for _, _, n, _ in got.elements()) == 8
