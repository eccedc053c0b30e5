import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from causeway.llm import decontamination, language_id, language_model, license_scan, toxicity
from pyspark.sql import functions as F
from tests.llm.rows import ALNUM, corpus, frame, lower, words

DOCS = corpus()


def expected_hits(docs, items):
    windows = {}
    for i, text in items:
        w = words(lower(text), ALNUM)
        for k in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(i))
    out = []
    for i, text, *_ in docs:
        w, hit, names = words(lower(text), ALNUM), set(), set()
        for n in set(map(len, windows)):
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    names |= windows[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


ITEMS = [(1, DOCS[80][1]), (2, " ".join(words(DOCS[5][1])[2:20]) or "none"), (10, "Solo"), (11, "x-X"), (12, None), (13, " .. "),
         (14, " ".join(words(DOCS[60][1])[50:63])), (15, "solo"), (16, " ".join(words(DOCS[96 if len(DOCS) > 96 else -5][1])[:9]))]


@pytest.mark.parametrize("block_words", [4_000_000, 30])
def test_decontamination_matches_brute_force(spark, block_words):
    found = decontamination.matches(frame(spark, DOCS), benchmark(spark, ITEMS), block_words=block_words)
    assert sorted(map(tuple, decontamination.summary(found).collect())) == expected_hits(DOCS, ITEMS)


def test_suffix_array_and_search_match_plain_sorting():
    draw = np.random.default_rng(3)
    for window in (1, 2, 3, 7, 10, 16, 19):
        sequence = draw.integers(1, 4, 400).astype(np.uint64)
        sequence[[0, 90, 91, 250, 399]] = 0
        padded = sequence.tolist() + [0] * window
        suffix = lambda p: padded[p:p + window]
        places = decontamination.suffix_array(sequence, window)[2]
        assert sorted(places) == list(range(400)) and [suffix(p) for p in places] == sorted(map(suffix, range(400)))
        sizes = draw.integers(1, 30, 20)
        items = [draw.integers(1, 5, n).astype(np.uint64) for n in sizes] + [sequence[100:140]]
        block = decontamination.Block([str(k) for k in range(21)], np.concatenate(items), np.concatenate([[0], np.cumsum([len(i) for i in items])]))
        m = decontamination.search(sequence, block, window)
        full = decontamination.longest(m)
        want = set()
        for k, words_ in enumerate(items):
            n, it = min(len(words_), window), words_.tolist()
            for q in range(len(it) - n + 1):
                for p in range(400):
                    if padded[p:p + n] == it[q:q + n]:
                        e = n
                        while q + e < len(it) and padded[p + e] == it[q + e]:
                            e += 1
                        want.add((p, k, q, n, e))
        got = list(zip(*(v.tolist() for v in (m.position, m.item, m.place, m.length, full))))
        assert len(got) == len(want) and set(got) == want


def test_longest_matches_and_their_places(spark):
    item = " ".join(f"b{k}" for k in range(30))
    doc = "lead in " + " ".join(f"b{k}" for k in range(4, 25)) + " tail"
    row = decontamination.matches(frame(spark, [(1, doc, "en", "a")]), benchmark(spark, [(7, item)])).first()
    assert row["start"] == list(range(2, 14)) and row["place"] == list(range(4, 16)) and row["longest"] == list(range(21, 9, -1))


def test_decontamination_empty_tables(spark):
    none = decontamination.summary(decontamination.matches(frame(spark, DOCS[:3]), benchmark(spark, []))).collect()
    assert [r["n_hit"] for r in none] == [0, 0, 0] and not any(r["contaminated"] for r in none)
    assert decontamination.matches(frame(spark, []), benchmark(spark, ITEMS)).collect() == []


@pytest.fixture(params=[12 << 20, 2000])
def spans_of_size(request, monkeypatch):
    monkeypatch.setattr(language_model, "SPAN_BYTES", request.param)


def fold(i):
    return zlib.crc32(str(i).encode()) % 7


def test_language_model_counts_and_scores_match_brute_force(spark, spans_of_size):
    rows = DOCS
    tokens = {i: words(lower(t)) + [""] for i, t, *_ in rows}
    got = {r["doc_id"]: r for r in language_model.scores(frame(spark, rows)).collect()}
    train = [i for i in tokens if fold(i) != 2]
    one = Counter(w for i in train for w in tokens[i])
    n, v = sum(one.values()), len(one)
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r["held_out"] == (fold(i) == 2) and r["train_tokens"] == n and r["n_tokens"] == len(tokens[i])
        assert r["n_known"] == sum(one[w] > 0 for w in tokens[i])
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in tokens[i])
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    # the model itself, with the weights that the same learning gives on plain counts
    kept = [i for i in train if fold(i) != 3]
    c1 = Counter(w for i in kept for w in tokens[i])
    c2 = Counter(p for i in kept for p in zip([None] + tokens[i][:-1], tokens[i]))
    total = sum(c1.values())

    def ctx(c, u):
        return c[""] if u is None else c[u]
    cells = Counter()
    for i in train:
        if fold(i) == 3:
            for u, w in zip([None] + tokens[i][:-1], tokens[i]):
                c = ctx(c1, u)
                b = int(math.floor(math.log2(c))) + 1 if c else 0
                q = [round(4 * math.log2(p)) if p > 0 else 1 for p in (c2[u, w] / max(c, 1), c1[w] / total)]
                cells[b, q[0], q[1]] += 1
    weights = language_model.learn([dict(bucket=b, pair=p, word=w, n=k) for (b, p, w), k in sorted(cells.items())], len(c1))
    f2 = Counter(p for i in train for p in zip([None] + tokens[i][:-1], tokens[i]))
    for i in list(tokens)[::7]:
        score = 0.0
        for u, w in zip([None] + tokens[i][:-1], tokens[i]):
            c = ctx(one, u)
            a, b = weights[int(math.floor(math.log2(c))) + 1 if c else 0]
            score += math.log10(a * f2[u, w] / max(c, 1) + b * one[w] / n + (1 - a - b) / (v + 1))
        assert math.isclose(got[i]["score"], score, rel_tol=1e-6)


def test_probabilities_of_a_context_sum_to_at_most_one():
    cells = [dict(bucket=3, pair=-4, word=-20, n=50), dict(bucket=3, pair=1, word=1, n=9)]
    weights = language_model.learn(cells, 100)
    assert ((weights >= 0) & (weights <= 1)).all() and (weights.sum(1) <= 1).all() and weights[0, 0] == 0
    assert (weights[4] == weights[3]).all()


def test_language_model_without_rows(spark):
    assert language_model.scores(frame(spark, [])).collect() == []
    r = language_model.scores(frame(spark, [(1, None, None, None)] * 2)).collect()
    assert len(r) == 2 and all(x["n_tokens"] == 1 and math.isfinite(x["score"]) for x in r)


STEMS = {"en": "the and ing tion of", "de": "der und ung ich keit", "fr": "les eau tion que ment", "es": "los que mente cion ar"}


def tongue(rng, lang):
    parts = STEMS[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.choice([1, 1, 2, 3]))) for _ in range(rng.choice([8, 40, 200])))


def test_languages_held_out_accuracy_and_undetermined(spark):
    rng = random.Random(4)
    rows = [(i, tongue(rng, lang), lang if i % 9 else None, "a") for i, lang in enumerate(rng.choices(list(STEMS), k=400))]
    truth = {i: t for i, t in enumerate(r[2] for r in rows)}
    rows += [(1000, None, "en", "a"), (1001, " 12 ++ ", "en", "a"), (1002, "", "de", None), (1003, "É", "fr", "a")]
    got = {r["doc_id"]: r for r in language_id.languages(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2 and truth[i]]
    assert all(got[i]["held_out"] for i in held) and sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["score"] == 0 and got[1003]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_without_labels_or_rows(spark):
    assert [r["lang_pred"] for r in language_id.languages(frame(spark, [(1, "abc", None, "a")])).collect()] == ["und"]
    assert language_id.languages(frame(spark, [])).collect() == []
    assert [r["lang_pred"] for r in language_id.languages(frame(spark, [(k, "abc", "xx", "a") for k in range(9)])).collect()] == ["xx"] * 9


NAMES = ["rude", "severe"]


def categories():
    return {n: F.col(n) == 1 for n in NAMES}


def toxic_table(n=500, seed=5):
    rng = random.Random(seed)
    plain = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(plain, k=rng.choice([5, 30, 200]))
        rude = i % 8 == 0
        severe = i % 16 == 0
        if rude:
            for _ in range(2):
                w[rng.randrange(len(w))] = "foulx" + rng.choice("abcdef") * 3
        if severe:
            w[rng.randrange(len(w))] = "viledeed"
        rows.append((i, " ".join(w), "en", "a"))
        if i % 3:
            labels.append((i, int(rude), int(severe), None))
    return rows, labels


def test_toxicity_finds_unlabelled_documents_and_leaves_clean_ones(spark):
    rows, labels = toxic_table()
    rows += [(9000, None, None, None), (9001, "", "en", "a"), (9002, "w1 FOULXaaa!! w2", "en", "a")]
    marks = spark.createDataFrame(labels + [labels[0], (None, 1, 1, 1), (77777, 1, 1, 1), (3, None, None, None)], "doc_id long, rude int, severe int, x int")
    docs = frame(spark, rows)
    chain = toxicity.fit(docs, marks, categories())
    assert [link.name for link in chain] == ["rude", "severe"] and len(chain[1].weights) == len(chain[1].features) + 2
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain, NAMES).collect()}
    assert len(got) == len(rows)
    wrong = [i for i in range(500) if (got[i]["p_rude"] >= chain[0].threshold) != (i % 8 == 0)]
    assert len(wrong) <= 4
    assert got[9002]["p_rude"] > 0.5 > max(got[9000]["p_rude"], got[9001]["p_rude"])
    assert sum((got[i]["p_severe"] >= chain[1].threshold) == (i % 16 == 0) for i in range(500)) >= 490


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, rude int, severe int")
    docs = frame(spark, [(1, "a b", "en", "a")])
    assert toxicity.fit(docs, none, categories()) == []
    assert tuple(toxicity.score(docs, [], NAMES).first()) == (1, 0.0, 0.0)
    rows, labels = toxic_table(60)
    chain = toxicity.fit(frame(spark, rows), spark.createDataFrame([x[:3] for x in labels], "doc_id long, rude int, severe int"), categories())
    assert toxicity.score(frame(spark, []), chain, NAMES).collect() == []


def test_licences_own_inherited_and_none(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0.", None, "top"), (2, "plain words", None, "top/sub"), (3, "plain words and more of them\n// Released under the MIT License.\nmore words follow here", None, "top/sub"),
            (4, "This work is licensed under the GNU General Public License, version 3.", None, "top/sub/deep"), (5, "words", None, "top/sub/deep/er"),
            (6, "words", None, "other"), (7, None, None, None), (8, "", None, "top"), (9, "we sell a driving license to everybody who asks nicely", None, "other"),
            (10, "Licensed under CC BY-NC 4.0.", None, "top"), (2, "plain words", None, "top/sub")]
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    got = sorted((r["doc_id"], r["license"], r["origin"], r["license_dir"]) for r in license_scan.scan(frame(spark, rows), path).collect())
    assert got == [(1, "Apache-2.0", "own", None), (2, "Apache-2.0", "inherited", "top"), (2, "Apache-2.0", "inherited", "top"), (3, "MIT", "own", None),
                   (4, "GPL-3.0", "own", None), (5, "GPL-3.0", "inherited", "top/sub/deep"), (6, None, "none", None), (7, None, "none", None),
                   (8, "Apache-2.0", "inherited", "top"), (9, None, "none", None), (10, "CC-BY-NC-4.0", "own", None)]
    assert license_scan.scan(frame(spark, []), path).collect() == []


def licence_rows():
    wrapped = license_scan.licence_texts()
    mit = wrapped["MIT"].replace("<year> <copyright holders>", "2024 Ada Byron and others")
    bsd = wrapped["BSD-3-Clause"].replace("The Regents of the University of California", "Some Company of Somewhere")
    prose = " ".join(f"word{k}" for k in range(300))
    return [(1, mit, None, "m"), (2, prose, None, "m/sub"), (3, bsd, None, "b"), (4, "plain", None, "b"), (5, " ".join(wrapped["GPL-3.0"].split()), None, "g"), (6, "plain", None, "g"),
            (7, prose + " Released under the MIT License. " + prose, None, "x"), (8, "plain", None, "x"), (9, prose + "\n" + mit + "\n" + prose, None, "y"), (10, "plain", None, "y"),
            (11, prose + " see the license of the driver " + prose, None, "z")]


def test_whole_licence_texts_and_notices_inside_long_lines(spark):
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    got = sorted((r["doc_id"], r["license"], r["origin"], r["license_dir"]) for r in license_scan.scan(frame(spark, licence_rows()), path).collect())
    assert got == [(1, "MIT", "own", None), (2, "MIT", "inherited", "m"), (3, "BSD-3-Clause", "own", None), (4, "BSD-3-Clause", "inherited", "b"),
                   (5, "GPL-3.0", "own", None), (6, "GPL-3.0", "inherited", "g"), (7, "MIT", "own", None), (8, None, "none", None),
                   (9, "MIT", "own", None), (10, None, "none", None), (11, None, "none", None)]


def test_every_licence_text_is_told_from_its_kin(spark):
    texts = list(license_scan.licence_texts().items())
    rows = [(k, "Copyright 2020 Jane Doe\n" + text, None, name) for k, (name, text) in enumerate(texts)]
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    assert {r["doc_id"]: r["license"] for r in license_scan.scan(frame(spark, rows), path).collect()} == {k: name for k, (name, _) in enumerate(texts)}


@pytest.mark.parametrize("block_words", [decontamination.BLOCK_WORDS, 12])
def test_rows_without_an_id_and_texts_of_one_id_stay_apart(spark, block_words):
    items = [(1, "a b c d e f g h i j k"), (2, "one two three"), (3, "zz yy xx")]
    rows = [(None, "pre one two three", "en", "a"), (None, "pre two one three", "en", "a"), (4, "zz yy xx qq", "en", "a"), (4, "qq xx yy zz", "en", "a"), (4, "zz yy xx qq", "en", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.summary(decontamination.matches(frame(spark, rows), bench, block_words=block_words))
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in found.collect()), key=str)
    assert got == sorted([(None, 4, 3, True), (None, 4, 0, False), (4, 4, 3, True), (4, 4, 0, False), (4, 4, 3, True)], key=str)


def test_licences_of_rows_without_an_id_and_of_texts_of_one_id(spark):
    rows = [(None, "Released under the MIT License", "en", "a"), (None, "nothing of the kind", "en", "a"), (5, "plain words only", "en", "b"),
            (5, "Released under the MIT License\nand more words that are not a licence at all, many of them here", "en", "b"), (5, "plain words only", "en", "b")]
    path = F.concat_ws("/", "source", F.coalesce(F.md5("text"), F.lit("x")))
    got = sorted(((r["doc_id"], r["license"], r["origin"]) for r in license_scan.scan(frame(spark, rows), path).collect()), key=str)
    assert [g for g in got if g[0] is None] == [(None, "MIT", "inherited"), (None, "MIT", "own")]
    assert [g for g in got if g[0] == 5] == [(5, "MIT", "own"), (5, None, "none"), (5, None, "none")]
