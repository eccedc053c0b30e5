"""Alignment of two tokenizers over the same texts, and which tokens correspond over a corpus.

1. Every text is encoded by A and B without special tokens: A gets a space and the text, B the text, to
   which it adds the space itself. A token's bytes come from the vocabulary; a text whose joined bytes
   of A or of B are not space and text has no tokens. Where both tokenizers part text before a space that
   follows another character (``cuts_at_spaces``), each different unit between such places is encoded once
   for ``SPAN_BYTES`` of texts, and not again as long as it is kept. Units are kept in Arrow and numpy
   arrays and found with Arrow's hash tables, which compare their bytes.
2. Batch by batch the token starts of one side meet the other side's in ``pandas.merge_asof``, keyed by
   document: each start finds the token that covers it. Both directions together are all overlaps.
   Overlaps whose tokens end together close the groups.
3. A link is a pair of one A and one B token of a group. Pairs of ids are counted by documents: within
   spans of texts first, then over the corpus. Large groups are multiplied out by distinct ids, a
   bounded part at a time.
4. The spans (``BATCH_BYTES`` of texts or one longer text), which keep their token ids in a written layer
   of small row groups, look up their links' counts. The counts are read in parts of at most
   ``PART_PAIRS`` id pairs (cut between A ids), and each part is broadcast alone.

Null and empty texts have no tokens: all numbers are zero. Repeated rows and different texts of one id
count as a document each and give a row each; rows without an id too. An empty table gives an empty
result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from causeway.llm.tokens import chunks
from causeway.session import write_layer

FILE_A = "/opt/tokenizers/byte_bpe_50k.json"
FILE_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are aligned at a time and make a span, and bytes that are encoded at a time.
BATCH_BYTES = 1 << 20
SPAN_BYTES = 1 << 22
#: Links, and counted id pairs, that are held at a time.
LINKS = 1 << 19
PART_PAIRS = 2_000_000
#: About the bytes that a worker keeps of units and their token ids between lookups, and what a unit takes besides its own.
KEPT_BYTES, UNIT_BYTES = 1 << 25, 40
#: Units that are encoded as one text, and texts whose tokens are put together at a time.
BLOCK_UNITS, PACKED_TEXTS = 200, 256
#: The layer's rows are large: row groups are closed by their bytes, not only after the usual 100 rows.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: White space: ASCII bytes, and the UTF-8 of the other characters, as numbers, by length.
WHITE = np.array([chr(b).isspace() and b < 0x80 for b in range(256)])
WIDE = {n: np.array([int.from_bytes(c, "big") for c in (chr(k).encode() for k in range(0x80, 0x10000) if chr(k).isspace()) if len(c) == n]) for n in (2, 3)}


def byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


def cuts_at_spaces(file_a: str, file_b: str) -> bool:
    """Whether no token of A or B, and no choice between tokens, reaches over the place before a space that follows another character."""
    from sentencepiece import sentencepiece_model_pb2
    with open(file_a, encoding="utf-8") as f:
        a = json.load(f)
    plain = {"normalizer": None, "truncation": None, "padding": None, "post_processor": None}
    splits = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    whole_a = any(a.get(k) != v for k, v in plain.items()) or any((a["pre_tokenizer"] or {}).get(k) != v for k, v in splits.items())
    if whole_a or a["model"]["type"] != "BPE" or a["model"].get("dropout") or not all(t["special"] for t in a["added_tokens"]):
        return False
    b = sentencepiece_model_pb2.ModelProto()
    with open(file_b, "rb") as f:
        b.ParseFromString(f.read())
    rules = b.normalizer_spec
    return (b.trainer_spec.model_type == b.trainer_spec.BPE and not b.trainer_spec.treat_whitespace_as_suffix and not rules.precompiled_charsmap
            and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
            and not any(p.type == p.USER_DEFINED or re.search("[^▁]▁", p.piece) for p in b.pieces))


class Sides:
    """Both tokenizers, loaded once in a worker."""

    _loaded: dict[tuple[str, str], Sides] = {}

    @classmethod
    def load(cls, file_a: str, file_b: str) -> Sides:
        if (file_a, file_b) not in cls._loaded:
            cls._loaded[file_a, file_b] = cls(file_a, file_b)
        return cls._loaded[file_a, file_b]

    def __init__(self, file_a: str, file_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=file_b)
        table, entries = byte_of(), [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            entries[k] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.entries = entries, [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(e) for e in x], np.int64) for x in self.entries)
        self.by_unit = cuts_at_spaces(file_a, file_b)
        self.forget()

    @property
    def sizes(self) -> tuple[int, int]:
        return len(self.size_a), len(self.size_b)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [e.ids for e in a], self.b.encode(texts, num_threads=1)

    def alike(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether the tokens of A and of B join to space and text."""
        want = (" " + text).encode()
        return all(b"".join(map(entries.__getitem__, ids)) == want for entries, ids in zip(self.entries, (a, b)))

    def whole(self, text: str) -> tuple[bytes, bytes]:
        (a,), (b,) = self.encode([text])
        return (array("i", a).tobytes(), array("i", b).tobytes()) if self.alike(text, a, b) else (b"", b"")

    def learn(self, units: pa.LargeBinaryArray) -> np.ndarray:
        """Encodes units that are not known and gives their rows among the known ones."""
        data, offsets = bytes_of(units)
        # white space at the end of a unit would go with the next unit's space
        tail = after_space(data, offsets[1:])
        joined, apart = np.flatnonzero(~tail), [np.flatnonzero(tail)]
        order, learnt = [], []
        for k in range(0, len(joined), BLOCK_UNITS):
            block = joined[k:k + BLOCK_UNITS]
            if shares := self.cut(units.take(pa.array(block))):
                order.append(block)
                learnt.append(shares)
            else:
                apart.append(block)
        apart, unlike = np.concatenate(apart), np.zeros(len(units), bool)
        for k in range(0, len(apart), BLOCK_UNITS):
            block = apart[k:k + BLOCK_UNITS]
            texts = [u.decode()[1:] for u in units.take(pa.array(block)).to_pylist()]  # every unit begins with a space
            a, b = self.encode(texts)
            b = [ids or [self.b.piece_to_id("▁")] for ids in b]  # B adds no space to nothing
            unlike[block] = [not self.alike(*x) for x in zip(texts, a, b)]
            learnt.append(tuple((np.array([i for x in side for i in x], np.int32), np.array([len(x) for x in side])) for side in (a, b)))
        order = np.concatenate([*order, apart])
        rows = np.empty(len(units), np.int64)
        rows[order] = len(self.units) + np.arange(len(units))
        self.units = pa.concat_arrays([self.units, units.take(pa.array(order))])
        self.unlike = np.concatenate([self.unlike, unlike[order]])
        for side, old in enumerate(self.ids):
            ids, counts = (np.concatenate([kept, *[shares[side][part] for shares in learnt]]) for part, kept in enumerate(old))
            self.ids[side] = ids.astype(old[0].dtype), counts.astype(old[1].dtype)
        return rows

    def cut(self, block: pa.LargeBinaryArray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """Tokens of the joined units of each side, and how many each unit has; none if they don't give back their bytes or don't end wherever a unit ends."""
        data, offsets = bytes_of(block)
        text = data.tobytes().decode()[1:]
        (a,), (b,) = self.encode([text])
        if not self.alike(text, a, b):
            return ()
        shares = []
        for ids, size in ((a, self.size_a), (b, self.size_b)):
            ids = np.array(ids, np.int32)
            at = np.cumsum(size[ids])
            last = np.searchsorted(at, offsets[1:])
            if (at[last] != offsets[1:]).any():
                return ()
            shares.append((ids, np.diff(last, prepend=-1)))
        return tuple(shares)

    def tokens(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Token ids of A and of B as packed 32-bit numbers, none for a text that they do not give back."""
        if not self.by_unit or not texts:
            return [self.whole(t) for t in texts]
        units, first = cut_units(texts)
        found = units.dictionary_encode()
        at = pc.index_in(found.dictionary, value_set=self.units)
        rows = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if at.null_count:
            rows[rows < 0] = self.learn(found.dictionary.filter(at.is_null()))
        rows = rows[found.indices.to_numpy()]
        packed = [self.packed(side, rows, first) for side in (0, 1)]
        unlike = np.add.reduceat(self.unlike[rows], first[:-1], dtype=np.int64) > 0
        if len(self.units) * UNIT_BYTES + self.units.nbytes + sum(ids.nbytes for ids, _ in self.ids) > KEPT_BYTES:
            self.forget()
        return [self.whole(t) if odd else both for t, odd, both in zip(texts, unlike.tolist(), zip(*packed))]

    def packed(self, side: int, rows: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The tokens of one side of each text, from the rows of its units."""
        ids, counts = self.ids[side]
        starts, out = np.cumsum(counts, dtype=np.int64) - counts, []
        for k in range(0, len(first) - 1, PACKED_TEXTS):
            ends = first[k:k + PACKED_TEXTS + 1]
            own = rows[ends[0]:ends[-1]]
            upto = np.concatenate([[0], np.cumsum(counts[own], dtype=np.int64)])
            body = ids[np.arange(upto[-1]) + np.repeat(starts[own] - upto[:-1], counts[own])].astype(np.int32).tobytes()
            stops = (4 * upto[ends - ends[0]]).tolist()
            out += [body[x:y] for x, y in zip(stops, stops[1:])]
        return out

    def forget(self) -> None:
        #: Units met so far, which of them do not give back their bytes, and by side their token ids and how many each has.
        self.units = pa.array([], pa.large_binary())
        self.unlike = np.zeros(0, bool)
        self.ids = [(np.zeros(0, np.uint16 if top <= 1 << 16 else np.uint32), np.zeros(0, np.int32)) for top in self.sizes]


def bytes_of(units: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes, and where each value begins and the last ends in them."""
    offsets = np.frombuffer(units.buffers()[1], np.int64)[units.offset:units.offset + len(units) + 1]
    body = units.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def after_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space."""
    one, two, three = (data[np.maximum(at - k, 0)].astype(np.int64) for k in (1, 2, 3))
    out = WHITE[one]
    wide = np.flatnonzero(one >= 0x80)
    one, two, three = one[wide], two[wide], three[wide]
    out[wide] = np.isin(two << 8 | one, WIDE[2]) | np.isin(three << 16 | two << 8 | one, WIDE[3])
    return out


def cut_units(texts: list[str]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The units of all texts, each after a space, one after the other, and where each text's begin: a unit reaches from a space that follows another character to the next such space."""
    data, offsets = bytes_of(pa.array([" " + t for t in texts], pa.large_string()).cast(pa.large_binary()))
    spaces = np.flatnonzero(data == 0x20)
    begins = ~after_space(data, spaces)
    begins[np.searchsorted(spaces, offsets[:-1])] = True
    starts = spaces[begins]
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
    return units, np.append(np.searchsorted(starts, offsets[:-1]), len(starts))


@dataclass
class Aligned:
    """Tokens of several documents one after the other. ``first_a[d]:first_a[d + 1]`` are the A tokens of document d, ``ends_a``
    their ends in the joined bytes; (``over_a``, ``over_b``) are all overlaps, sorted; ``cut_a``/``cut_b`` the last tokens of the groups."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    over_a: np.ndarray
    over_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray

    def __post_init__(self) -> None:
        self.n_a, self.n_b = np.diff(self.cut_a, prepend=-1), np.diff(self.cut_b, prepend=-1)
        #: Groups of document d: first_group[d]:first_group[d + 1].
        self.first_group = np.searchsorted(self.cut_a, self.first_a)

    def written(self, sizes: tuple[int, int]) -> list[str]:
        """A digest of each document's groups, '' for one without tokens."""
        table = _written(sizes)
        group_a, group_b = (np.repeat(np.arange(len(n)), n) for n in (self.n_a, self.n_b))
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.cut_a], last_b[self.cut_b] = True, True
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + (np.cumsum(self.n_b) - self.n_b)[group_a]] = 2 * self.a + last_a
        code[np.arange(len(self.b)) + np.cumsum(self.n_a)[group_b]] = 2 * sizes[0] + 2 * self.b + last_b
        names = table[code]
        bounds = self.first_a + self.first_b
        return [hashlib.sha256(b"".join(names[x:y])[:-1]).hexdigest() if y > x else "" for x, y in zip(bounds[:-1], bounds[1:])]


_tables: dict[tuple[int, int], np.ndarray] = {}


def _written(sizes: tuple[int, int]) -> np.ndarray:
    """Each id with what follows it: ',' or '|' after A, ',' or ';' after B."""
    if sizes not in _tables:
        _tables[sizes] = np.array([b"%d%c" % (k, c) for size, marks in zip(sizes, (b",|", b",;")) for k in range(size) for c in marks], object)
    return _tables[sizes]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an A and a B token that share a byte, in order."""
    def side(ends: np.ndarray, first: np.ndarray, name: str) -> pd.DataFrame:
        return pd.DataFrame({"at": np.concatenate([[0], ends[:-1]])[:len(ends)], "doc": np.repeat(np.arange(len(first) - 1), np.diff(first)), name: np.arange(len(ends))})
    a, b = side(ends_a, first_a, "a"), side(ends_b, first_b, "b")
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    covered_a = pd.merge_asof(a, b, on="at", by="doc")
    covered_b = pd.merge_asof(b, a, on="at", by="doc")
    # pairs that start together are in both; starts that differ, in one
    again = covered_b["at"].to_numpy() == a["at"].to_numpy()[covered_b["a"]]
    left = np.concatenate([covered_a["a"], covered_b["a"][~again]]).astype(np.int64)
    right = np.concatenate([covered_a["b"], covered_b["b"][~again]]).astype(np.int64)
    order = np.argsort(left + right, kind="stable")  # overlaps advance on one side at least
    return left[order], right[order]


def encoded(texts: list[str | None], sides: Sides) -> list[tuple[bytes, bytes]]:
    filled = [k for k, t in enumerate(texts) if t]
    packed = [(b"", b"")] * len(texts)
    for k, both in zip(filled, sides.tokens([texts[k] for k in filled])):
        packed[k] = both
    return packed


def aligned(column: pa.Array, sides: Sides, encoded_bytes: int, batch_bytes: int) -> Iterator[tuple[int, int, Aligned]]:
    """(first text, how many, their tokens aligned) for ``batch_bytes`` of texts after ``batch_bytes``; more are encoded at a time, as they share units."""
    for some in chunks(column, encoded_bytes):
        texts = column.slice(some.lo, some.hi - some.lo)
        packed = encoded(texts.to_pylist(), sides)
        for c in chunks(texts, batch_bytes):
            yield some.lo + c.lo, c.hi - c.lo, align(packed[c.lo:c.hi], sides)


def align(packed: list[tuple[bytes, bytes]], sides: Sides) -> Aligned:
    size_a, size_b = (np.array([len(p[side]) // 4 for p in packed], np.int64) for side in (0, 1))
    a, b = (np.frombuffer(b"".join(p[side] for p in packed), np.int32).astype(np.int64) for side in (0, 1))
    first_a, first_b = (np.concatenate([[0], np.cumsum(s)]) for s in (size_a, size_b))
    ends_a, ends_b = np.cumsum(sides.size_a[a]), np.cumsum(sides.size_b[b])
    over_a, over_b = overlaps(ends_a, ends_b, first_a, first_b)
    closes = ends_a[over_a] == ends_b[over_b]
    return Aligned(a, b, first_a, first_b, ends_a, ends_b, over_a, over_b, over_a[closes], over_b[closes])


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """One row per document: token ids and their ends in bytes of space and text, the overlaps as token numbers from 0, and each token's group."""
    columns = ["a", "a_end", "b", "b_end", "overlap_a", "overlap_b", "group_a", "group_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides.load(file_a, file_b)
        for batch in batches:
            for lo, n, x in aligned(batch.column(1), sides, SPAN_BYTES, BATCH_BYTES):
                base_a, base_b = x.first_a[:-1], x.first_b[:-1]
                doc_a, doc_b = np.repeat(np.arange(n), np.diff(x.first_a)), np.repeat(np.arange(n), np.diff(x.first_b))
                zero = np.concatenate([[0], x.ends_a])[x.first_a[:-1]] if len(x.a) else np.zeros(n, np.int64)
                group_a = np.repeat(np.arange(len(x.n_a)), x.n_a) - x.first_group[doc_a]
                group_b = np.repeat(np.arange(len(x.n_b)), x.n_b) - x.first_group[doc_b]
                over = np.searchsorted(x.over_a, x.first_a)
                values = [(x.first_a, x.a), (x.first_a, x.ends_a - zero[doc_a]), (x.first_b, x.b), (x.first_b, x.ends_b - zero[doc_b]),
                          (over, x.over_a - base_a[doc_a[x.over_a]]), (over, x.over_b - base_b[doc_b[x.over_b]]), (x.first_a, group_a), (x.first_b, group_b)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), *[pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v)) for o, v in values]],
                                                 names=["doc_id", *columns])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} array<bigint>" for c in columns))


#: Columns of a span's token ids and group sizes.
PACKED = ("a", "b", "size_a", "size_b")


def squeeze(x: np.ndarray, top: int) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype(np.uint16 if top <= 1 << 16 else np.uint32).tobytes())


def unsqueeze(x: pa.Scalar, top: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_buffer()), np.uint16 if top <= 1 << 16 else np.uint32).astype(np.int64)


def spans(docs: DataFrame, id_col: str, text_col: str, file_a: str, file_b: str) -> DataFrame:
    """One row for each span of texts: numbers of its documents as arrays, its token ids and group sizes packed."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides.load(file_a, file_b)
        size_a, size_b = sides.sizes
        for batch in batches:
            for lo, n, x in aligned(batch.column(1), sides, SPAN_BYTES, BATCH_BYTES):
                links = np.add.reduceat(np.append(x.n_a * x.n_b, 0), x.first_group[:-1]) * (np.diff(x.first_group) > 0)
                columns = {"doc_id": batch.column(0).slice(lo, n), "n_a": np.diff(x.first_a), "n_b": np.diff(x.first_b), "n_groups": np.diff(x.first_group), "n_links": links,
                           "groups_sha256": x.written((size_a, size_b))}
                packed = dict(zip(PACKED, (squeeze(v, top) for v, top in ((x.a, size_a), (x.b, size_b), (x.n_a, 1 << 32), (x.n_b, 1 << 32)))))
                rows = pa.array([0, n], pa.int32())
                lists = [pa.ListArray.from_arrays(rows, v if isinstance(v, pa.Array) else pa.array(v)) for v in columns.values()]
                yield pa.RecordBatch.from_arrays([*lists, *[pa.array([v], pa.binary()) for v in packed.values()]], names=[*columns, *packed])
        # the worker goes on to the counts
        sides.forget()
        pa.system_memory_pool().release_unused()
    schema = (f"doc_id array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, "
              "a binary, b binary, size_a binary, size_b binary")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def products(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a * width + b, how often) for all pairs within each group, at most about ``most`` at a time."""
    start_a, start_b, size = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    ends, g = np.cumsum(size), 0
    while g < len(size):
        if size[g] > most:
            (u, cu), (v, cv) = (np.unique(x[s[g]:s[g] + n[g]], return_counts=True) for x, s, n in ((a, start_a, n_a), (b, start_b, n_b)))
            step = max(1, most // len(v))
            for k in range(0, len(u), step):
                yield (u[k:k + step, None] * width + v).ravel(), (cu[k:k + step, None] * cv).ravel()
            g += 1
            continue
        e = max(g + 1, int(np.searchsorted(ends, ends[g] - size[g] + most, side="right")))
        each = size[g:e]
        which = np.repeat(np.arange(g, e), each)
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        i, j = np.divmod(at, n_b[which])
        yield a[start_a[which] + i] * width + b[start_b[which] + j], np.ones(len(at), np.int64)
        g = e


def counted(code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sum of their weights."""
    order = np.argsort(code)
    code, weight = code[order], weight[order]
    begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[begin], np.add.reduceat(weight, begin) if len(begin) else weight


def document_links(row: dict[str, np.ndarray], width: int, most: int = LINKS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, id pair, how often linked) of one span, each once, some whole documents at a time."""
    first_a, first_b, group = (np.concatenate([[0], np.cumsum(row[c])]) for c in ("n_a", "n_b", "n_groups"))
    ends, d = np.cumsum(row["n_links"]), 0
    while d < len(ends):
        e = max(d + 1, int(np.searchsorted(ends, ends[d] - row["n_links"][d] + most, side="right")))
        sizes = [row[c][group[d]:group[e]] for c in ("size_a", "size_b")]
        a, b = row["a"][first_a[d]:first_a[e]], row["b"][first_b[d]:first_b[e]]
        if e == d + 1:
            pair, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for p, t in products(a, b, *sizes, width, most):
                pair, times = counted(np.concatenate([pair, p]), np.concatenate([times, t]))
            yield np.full(len(pair), d), pair, times
        else:
            (pair, _), = products(a, b, *sizes, width, 1 << 62) if len(a) else ((np.zeros(0, np.int64), None),)
            doc = np.repeat(np.arange(e - d), row["n_links"][d:e])
            # the documents' ranges of codes do not meet
            code, times = np.unique(doc * (1 << 42) + pair, return_counts=True)
            yield d + (code >> 42), code & ((1 << 42) - 1), times
        d = e


def opened(batch: pa.RecordBatch, k: int, sizes: tuple[int, int]) -> dict[str, np.ndarray]:
    top = {"a": sizes[0], "b": sizes[1], "size_a": 1 << 32, "size_b": 1 << 32}
    at = batch.schema.get_field_index
    return ({c: batch.column(at(c))[k].values.to_numpy() for c in ("n_a", "n_b", "n_groups", "n_links")}
            | {c: unsqueeze(batch.column(at(c))[k], top[c]) for c in top})


def pair_counts(layer: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """(pair, n, best): how many documents link each id pair (a * number of B ids + b), and whether that is the A id's highest."""
    width = sizes[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return counted(*map(np.concatenate, zip(*held)))

        def rows(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
        for batch in batches:
            for k in range(batch.num_rows):
                for _, p, _ in document_links(opened(batch, k, sizes), width, LINKS):
                    held.append(np.unique(p, return_counts=True))
                    total += len(held[-1][0])
                    if total > LINKS:
                        held = [merged()]
                        if len(held[0][0]) > LINKS // 2:
                            yield rows(*held.pop())
                        total = sum(len(u) for u, _ in held)
        if held:
            yield rows(*merged())
    found = layer.select("n_a", "n_b", "n_groups", "n_links", "a", "b", "size_a", "size_b").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    # an A id has no more pairs than there are B ids
    token = F.expr(f"pair div {width}")
    return found.withColumn("token", token).withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("token")))


def parts(pairs: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of A ids that have at most ``most`` pairs each (or one id)."""
    sizes = sorted(map(tuple, pairs.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()))
    out, begin, total = [], 0, 0
    for token, n in sizes:
        if total and total + n > most:
            out.append((begin, token))
            begin, total = token, 0
        total += n
    return [*out, (begin, 1 << 62)] if sizes else []


def looked_up(layer: DataFrame, part: DataFrame, low: int, high: int, sizes: tuple[int, int], last: bool) -> DataFrame:
    """The spans, with the counts of one part of the pairs added to ``n_best`` and ``count_sum`` of their documents; without the tokens if it is the last part."""
    rows = part.sort("pair").select("pair", "n", "best").toArrow()
    shared = layer.sparkSession.sparkContext.broadcast([rows.column(c).to_numpy() for c in ("pair", "n", "best")])
    width = sizes[1]
    kept = [c for c in layer.columns if not (last and c in PACKED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = opened(batch, k, sizes)
                n_best, total = (batch.column(batch.schema.get_field_index(c))[k].values.to_numpy().copy() for c in ("n_best", "count_sum"))
                for doc, pair, times in document_links(row, width, LINKS):
                    mine = (pair >= low * width) & (pair < min(high, 1 << 31) * width)
                    doc, times, at = doc[mine], times[mine], np.searchsorted(known, pair[mine])
                    np.add.at(total, doc, times * n[at])
                    np.add.at(n_best, doc, times * best[at])
                one = pa.array([0, len(total)], pa.int32())
                columns = [batch.column(batch.schema.get_field_index(c)).slice(k, 1) for c in kept[:-2]]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.ListArray.from_arrays(one, pa.array(v)) for v in (n_best, total)]], names=kept)
    return layer.mapInArrow(run, layer.select(kept).schema)


def correspondences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file_a: str = FILE_A, file_b: str = FILE_B,
                    part_pairs: int = PART_PAIRS) -> DataFrame:
    """One row per document: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    sizes = Sides.load(file_a, file_b).sizes
    layer = write_layer(spans(docs, id_col, text_col, file_a, file_b), "alignment-spans", LARGE_ROWS)
    pairs = write_layer(pair_counts(layer, sizes), "alignment-pairs")
    none = F.transform("n_a", lambda x: F.lit(0).cast("long"))
    out = layer.withColumn("n_best", none).withColumn("count_sum", none)
    ranges = parts(pairs, part_pairs)
    for k, (low, high) in enumerate(ranges):
        if k:
            out = write_layer(out, f"alignment-part-{k}", LARGE_ROWS)
        out = looked_up(out, pairs.where((F.col("token") >= low) & (F.col("token") < high)), low, high, sizes, k == len(ranges) - 1)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return out.select(F.inline(F.arrays_zip(*columns)))
