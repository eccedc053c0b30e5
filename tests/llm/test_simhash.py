import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from causeway.llm import simhash
from causeway.llm.tokens import U64
from tests.llm.rows import corpus, frame, lower, words


def slow_fingerprint(text):
    w = words(lower(text))
    grams = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, ids):
    """Least id reachable over links of at most 3 bits."""
    n = len(prints)
    p = np.array(prints, U64)
    near = np.bitwise_count(p[:, None] ^ p[None, :]) <= 3
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(1)
        new = np.minimum(label, new)
        if (new == label).all():
            break
        label = new
    least = {}
    for k in range(n):
        if ids[k] is not None:
            least[label[k]] = min(least.get(label[k], ids[k]), ids[k])
    return [least.get(label[k]) for k in range(n)]


def expected(rows):
    prints = [slow_fingerprint(r[1]) for r in rows]
    return sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, slow_components(prints, [r[0] for r in rows]))), key=str)


def got(df):
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("code", simhash.CODES, ids=["rm-rm", "golay-rm", "golay-golay"])
def test_documents_match_brute_force(spark, code):
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(400)]
    rows = corpus()
    for k in range(30):  # near copies: a few words of many are changed
        w = list(base)
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
        rows.append((1000 + k, " ".join(w), "en", "b"))
    want = expected(rows)
    assert got(simhash.near_duplicates(frame(spark, rows), code=code)) == want
    assert any(i != c for i, _, c in want if i is not None and i >= 1000)


def test_nulls_repeats_short_texts_and_empty_tables(spark):
    rows = [(5, None, None, None), (4, " \t\n", "en", "a"), (None, "", "en", "a"), (7, "one", "en", "a"), (7, "one", "en", "a"), (8, "ONE", "en", "a"),
            (9, "two words", "en", "a"), (9, "three other words", "en", "a"), (None, "alone here with five words", "en", "a"), (10, "two words É", "en", "a")]
    assert got(simhash.near_duplicates(frame(spark, rows))) == expected(rows)
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def test_fingerprint_hash_is_sparks_xxhash64(spark):
    value = spark.range(1).select(F.xxhash64(F.lit("straße und weg")).alias("h")).first()["h"]
    assert value & (1 << 64) - 1 == xxhash.xxh64_intdigest("straße und weg".encode(), 42)


def prints_frame(spark, values):
    return spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")


def clusters(seed, n, size):
    """Random fingerprints, each with a chain of neighbours at 0 to 5 bits."""
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        f = rng.getrandbits(64)
        for _ in range(size):
            out.add(f)
            for _ in range(rng.randrange(6)):
                f ^= 1 << rng.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("code", simhash.CODES, ids=["rm-rm", "golay-rm", "golay-golay"])
@pytest.mark.parametrize("cell", [2048, 7])
def test_links_lose_no_component(spark, code, cell):
    values = clusters(code.anchors, 60, 8)
    found = simhash.links(prints_frame(spark, values), code, cell=cell).collect()
    near = np.array(values, U64)
    at = {v: k for k, v in enumerate(near.view(np.int64).tolist())}
    label = simhash.spanning(np.array([at[a] for a, _ in found]), np.array([at[b] for _, b in found]), len(values))
    want = slow_components(values, list(range(len(values))))
    assert label.tolist() == want


def test_crowded_anchor_is_cut_into_cells(spark):
    """A ball of neighbours around one fingerprint: most share their anchors."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 900:
        f = centre
        for _ in range(rng.randrange(1, 5)):
            f ^= 1 << rng.randrange(64)
        values.add(f)
    found = simhash.links(prints_frame(spark, sorted(values)), simhash.CODES[0], cell=50)
    at = {v: k for k, v in enumerate(np.array(sorted(values), U64).view(np.int64).tolist())}
    rows = found.collect()
    label = simhash.spanning(np.array([at[a] for a, _ in rows]), np.array([at[b] for _, b in rows]), len(values))
    assert label.tolist() == slow_components(sorted(values), list(range(len(values))))


def test_code_grows_with_the_fingerprints():
    assert [simhash.choose(n).anchors for n in (0, 10 ** 6, 10 ** 7, 10 ** 12)] == [1 << 12, 1 << 12, 1 << 18, 1 << 24]
