import math
import warnings
from collections import Counter, defaultdict

import pytest

from causeway.llm import mixing, quality_rules
from tests.llm.rows import corpus, frame, words

DOCS = corpus()


def expected_measures(text):
    w = words(text)
    windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)), len(hit))


def test_quality_measures_match_brute_force(spark):
    rows = DOCS + [(500, "a b # c\n\na b # c\r\n|| <x> & $", "en", "a"), (501, "one two three four five one two three four five", "en", "a")]
    got = quality_rules.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        want = expected_measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_host_with_many_failures_is_rejected_and_small_hosts_are_not_judged_on_chance(spark):
    good = " ".join(f"w{k}" for k in range(20))
    rows = [(i, good, "en", "good") for i in range(200)] + [(1000 + i, "bad" if i < 190 else good, "en", "junk") for i in range(200)]
    rows += [(3000, "bad", "en", "tiny"), (3001, good, "en", None), (3002, good, "en", "")]
    rows += [(4000 + h * 50 + i, good, "en", f"h{h}") for h in range(20) for i in range(20)]
    got = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert all(got[i]["kept"] for i in range(200))
    assert all(got[1000 + i]["host_rejected"] and not got[1000 + i]["kept"] for i in range(200))
    assert not got[3000]["host_rejected"] and not got[3000]["kept"]
    assert got[3001]["kept"] and got[3002]["kept"]


def test_quality_empty_table_and_repeated_rows(spark):
    assert quality_rules.judge(frame(spark, [])).collect() == []
    assert len(quality_rules.judge(frame(spark, [(1, "a", "en", "a")] * 4)).collect()) == 4


def brute_mix(rows, evenness, max_epochs):
    tokens = Counter()
    for _, t, _, s in rows:
        tokens[s] += len(words(t))
    n = {s: v for s, v in tokens.items() if v}
    total = sum(n.values())

    def fits(a):
        w = {s: (v / total) ** a for s, v in n.items()}
        z = sum(w.values())
        entropy = -sum(x / z * math.log(x / z) for x in w.values())
        return entropy <= evenness * math.log(len(n)) + 1e-12 and max((v / max(n.values())) ** (a - 1) for v in n.values()) <= max_epochs + 1e-9
    low, high = 0.0, 1.0
    if not fits(1.0):
        return tokens, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return tokens, high


def test_mixture_matches_brute_force(spark):
    rows = [(i, "word " * (5 + i % 7), "en", "big" if i % 3 else f"s{i % 5}") for i in range(600)] + [(900, None, None, None), (901, "one two", None, None), (902, "", "en", "void")]
    tokens, exponent = brute_mix(rows, 0.9, 4.0)
    got = mixing.mix(frame(spark, rows), evenness=0.9, max_epochs=4.0, block_docs=20).collect()
    most = max(tokens.values())
    per, seen = defaultdict(lambda: Counter()), Counter()
    for r in got:
        per[r["source"]][r["epoch"]] += r["n_tokens"]
        seen[(r["doc_id"], r["epoch"])] += 1
    assert max(seen.values()) == 1                                     # once in an epoch
    assert {i for i, *_ in rows} == {i for i, _ in seen}               # nobody is lost
    for source, n in tokens.items():
        budget = round(most * (n / most) ** exponent) if n else 0
        whole, rest = divmod(budget, n) if n else (1, 0)
        assert [per[source][e] for e in range(whole)] == [n] * whole
        last = per[source][whole]
        assert last <= rest and (rest - last < 12 or rest == 0)        # only a document that does not fit is missing
        assert max(per[source]) <= whole


def test_mixture_order_is_a_permutation_of_blocks_that_repeats(spark):
    rows = [(i, "a b c", "en", "x" if i % 4 else "y") for i in range(400)]
    a, b = [sorted(map(tuple, mixing.mix(frame(spark, rows), block_docs=20, evenness=1.0).collect())) for _ in range(2)]
    assert a == b
    orders = defaultdict(list)
    for doc, source, epoch, block_rank, doc_rank, _ in sorted(a, key=lambda r: (r[1], r[2], r[3], r[4])):
        orders[(source, epoch)].append(doc)
    assert orders[("y", 0)] != orders[("y", 1)] and set(orders[("y", 1)]) <= set(orders[("y", 0)])


def test_mixture_empty_and_single_source(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    assert len(mixing.mix(frame(spark, [(1, "a", "en", "s")] * 3)).collect()) == 3
    assert len(mixing.mix(frame(spark, [(1, None, "en", "s"), (2, "", "en", None)])).collect()) == 2


def test_a_target_out_of_reach_is_said(spark):
    even = frame(spark, [(i, "w " * (100 if i else 95), "en", str(i)) for i in range(2)])
    with pytest.warns(UserWarning, match="evenness of 0.5"):
        assert len(mixing.mix(even, evenness=0.5).collect()) == 2
    with pytest.raises(ValueError):
        mixing.mix(even, evenness=0.5, unmet="error")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        mixing.mix(frame(spark, [(i, "w " * (1 if i else 400), "en", str(i)) for i in range(2)]))
