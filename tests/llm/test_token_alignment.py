import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from causeway.llm import token_alignment as ta
from tests.llm.rows import corpus, frame

A = Tokenizer.from_file(ta.FILE_A)
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=ta.FILE_B)
TABLE = ta.byte_of()


def tokens(text):
    """([(id, bytes)] of A, of B), or two empty lists."""
    if not text:
        return [], []
    a = [(i, bytes(TABLE[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[1:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    want = b" " + text.encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def ends(side):
    return np.cumsum([len(x) for _, x in side]).tolist()


def grouped(text):
    a, b = tokens(text)
    shared = sorted(set(ends(a)) & set(ends(b)))

    def at(side):
        out, now = [], []
        for (i, _), e in zip(side, ends(side)):
            now.append(i)
            if e in closing:
                out.append(now)
                now = []
        return out
    closing = set(shared)
    return list(zip(at(a), at(b), strict=True))


def slow(rows):
    docs = [grouped(r[1]) for r in rows]
    held = Counter(p for groups in docs for p in {(i, j) for x, y in groups for i in x for j in y})
    highest = defaultdict(int)
    for (i, _), n in held.items():
        highest[i] = max(highest[i], n)
    out = []
    for r, groups in zip(rows, docs):
        links = [(i, j) for x, y in groups for i in x for j in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((r[0], sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(held[p] == highest[p[0]] for p in links),
                    sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def hard_rows(n=1000):
    texts = [None, "", " ", "  two  spaces ", "a\nb\r\n\tc", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ already ▁there", "汉字和假名まじり文", "🙂🙂🏽 é ﬁ",
             "naïve straße «–»", "\u0000\u0001 control", "x" * 3000, "ab " * 3000, "한국어 텍스트", "ÿþý" * 50, "<|endoftext|>", "nul\x00byte", "trailing space ", "one", "one", "ſﬀ nbsp​"]
    return [(n + k, t, "en", "a") for k, t in enumerate(texts)] + [(None, "no id here", None, None), (n, "second text of an id", "en", "a"), (n + 18, "one", "en", "a")]


@pytest.mark.parametrize("part_pairs", [ta.PART_PAIRS, 300])
def test_documents_match_brute_force(spark, monkeypatch, part_pairs):
    monkeypatch.setattr(ta, "BATCH_BYTES", 5000)
    monkeypatch.setattr(ta, "SPAN_BYTES", 20_000)
    rows = [r for r in corpus() if len(r[1] or "") < 20_000] + hard_rows()
    got = ta.correspondences(frame(spark, rows), part_pairs=part_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows)


def test_empty_table_and_a_long_text(spark):
    assert ta.correspondences(frame(spark, [])).collect() == []
    assert [tuple(r) for r in ta.correspondences(frame(spark, [(1, None, None, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
    rng = random.Random(2)
    rows = [(1, " ".join(rng.choice(["über", "the", "word", "zzyzx", "1234", "\n"]) for _ in range(120_000)), "en", "a"), (2, "the word", "en", "a")]
    assert sorted(map(tuple, ta.correspondences(frame(spark, rows)).collect())) == slow(rows)


def test_alignments_hold_all_overlaps_and_groups(spark):
    rows = hard_rows()
    for r in ta.alignments(frame(spark, rows)).collect():
        text = next(t for i, t, *_ in rows if i == r["doc_id"] and len(tokens(t)[0]) == len(r["a"]))
        a, b = tokens(text)
        if [i for i, _ in a] != r["a"]:
            continue
        ea, eb = ends(a), ends(b)
        want = {(i, j) for i, x in enumerate(ea) for j, y in enumerate(eb) if max(x - len(a[i][1]), y - len(b[j][1])) < min(x, y)} if len(a) < 400 else None
        assert r["a_end"] == ea and r["b_end"] == eb
        assert want is None or (set(zip(r["overlap_a"], r["overlap_b"])) == want and len(r["overlap_a"]) == len(want))
        shared = sorted(set(ea) & set(eb))
        assert r["group_a"] == np.searchsorted(shared, ea).tolist() and r["group_b"] == np.searchsorted(shared, eb).tolist()


@pytest.mark.parametrize("most", [5, 60, 10 ** 6])
def test_links_of_large_groups_are_counted_in_parts(most):
    rng = np.random.default_rng(5)
    groups, per_doc = 40, np.array([3, 0, 1, 20, 16])
    n_a, n_b = rng.integers(1, 30, groups), rng.integers(1, 30, groups)
    a, b = rng.integers(0, 7, n_a.sum()), rng.integers(0, 5, n_b.sum())
    cut = np.concatenate([[0], np.cumsum(per_doc)])
    row = {"a": a, "b": b, "size_a": n_a, "size_b": n_b, "n_groups": per_doc, **{c: np.array([n[x:y].sum() for x, y in zip(cut[:-1], cut[1:])]) for c, n in (("n_a", n_a), ("n_b", n_b), ("n_links", n_a * n_b))}}
    want, ia, ib, g = Counter(), 0, 0, 0
    for doc, n in enumerate(per_doc):
        for _ in range(n):
            want.update((doc, int(i) * 5 + int(j)) for i in a[ia:ia + n_a[g]] for j in b[ib:ib + n_b[g]])
            ia, ib, g = ia + n_a[g], ib + n_b[g], g + 1
    got = [(int(d), int(p), int(t)) for block in ta.document_links(row, 5, most) for d, p, t in zip(*block)]
    assert len(got) == len(want) and {(d, p): t for d, p, t in got} == want


def test_units_are_encoded_in_blocks_and_give_each_text_its_own_tokens(monkeypatch):
    sides, encoded = ta.Sides(ta.FILE_A, ta.FILE_B), []
    encode = sides.encode
    monkeypatch.setattr(sides, "encode", lambda texts: encoded.extend(texts) or encode(texts))
    plain = [f"w{k} größe{k * k} «n{k}», " * 3 + f"end\t{k}" for k in range(2000)]
    odd = [t for _, t, *_ in hard_rows() if t] + ["tail \n", "tail\n", " x", "x▁y z", "z\x1c ", "z\x85 q", "q　 r", "r "]
    for texts in (plain, odd + plain[:50]):
        encoded.clear()
        got = sides.tokens(texts)
        for text, (a, b) in zip(texts, got, strict=True):
            want_a, want_b = tokens(text)
            assert np.frombuffer(a, np.int32).tolist() == [i for i, _ in want_a] and np.frombuffer(b, np.int32).tolist() == [i for i, _ in want_b]
        if texts is plain:
            assert len(encoded) < 100


def test_layer_rows_and_row_groups_stay_small(spark, monkeypatch):
    """Rows of a whole span were several MB, and Parquet closes a row group after 100 rows at the earliest."""
    monkeypatch.setattr(ta, "BATCH_BYTES", 3000)
    monkeypatch.setattr(ta, "SPAN_BYTES", 12_000)
    monkeypatch.setattr(ta, "LARGE_ROWS", {**getattr(ta, "LARGE_ROWS", {}), "parquet.block.size": "65536"}, raising=False)
    written, write = {}, ta.write_layer
    monkeypatch.setattr(ta, "write_layer", lambda df, name, *options: written.setdefault(name, write(df, name, *options)))
    rng = random.Random(7)
    rows = [(k, " ".join("%x" % rng.getrandbits(24) for _ in range(rng.randint(200, 350))), "en", "a") for k in range(300)]
    got = ta.correspondences(frame(spark, rows).coalesce(1))
    size = {k: len(t) for k, t, *_ in rows}
    assert all(len(r["doc_id"]) == 1 or sum(map(size.get, r["doc_id"])) <= 3000 for r in written["alignment-spans"].collect())
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in written["alignment-spans"].inputFiles()]
    groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) > 150 and max(g.total_byte_size for g in groups) < 2 * 65536
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows)


@pytest.mark.parametrize("links", [1, 40, 2000])
def test_id_pairs_are_counted_a_bounded_number_at_a_time(spark, monkeypatch, links):
    monkeypatch.setattr(ta, "BATCH_BYTES", 2000)
    monkeypatch.setattr(ta, "LINKS", links)
    rows = hard_rows()
    assert sorted(map(tuple, ta.correspondences(frame(spark, rows)).collect()), key=str) == slow(rows)


def test_units_are_cut_before_spaces_that_follow_another_character():
    unit = re.compile(r"\s*+\S++(?:[^\S ]\s*+\S*+)*+|\s++")
    white = [chr(k) for k in range(0x3100) if chr(k).isspace()]
    texts = [t for _, t, *_ in hard_rows() if t] + [f"a{w} b {w}c{w}" for w in white] + ["à b\u0085 c", "\ufffe x\u2028 y", "𐠀 z", ""]
    units, first = ta.cut_units(texts)
    got = [u.decode() for u in units.to_pylist()]
    assert [got[x:y] for x, y in zip(first[:-1], first[1:], strict=True)] == [unit.findall(" " + t) for t in texts]


def test_units_that_are_kept_stay_bounded_and_tokens_the_same(monkeypatch):
    texts = [" ".join(f"{k}.{n}" for n in range(40)) for k in range(300)] + ["tail \n", "x▁y z", "one"]
    monkeypatch.setattr(ta, "KEPT_BYTES", 20_000)
    sides = ta.Sides(ta.FILE_A, ta.FILE_B)
    for k in range(0, len(texts), 10):
        for text, both in zip(texts[k:k + 10], sides.tokens(texts[k:k + 10]), strict=True):
            assert [np.frombuffer(x, np.int32).tolist() for x in both] == [[i for i, _ in side] for side in tokens(text)]
        assert sides.units.nbytes + sum(ids.nbytes + counts.nbytes for ids, counts in sides.ids) <= 20_000
