"""Benchmark decontamination by suffix arrays of training shards.

A shard is a few megabytes of whole texts. Its words (ASCII letters and digits, and everything
beyond ASCII; A-Z lowered) become one sequence with a separator after each text. The suffixes of
that sequence are sorted to the depth of the window by prefix doubling. Every test suffix is then
binary-searched: its first word gives a range of the array, and each further word narrows the range
by two binary searches, until the window is complete or the range is empty. What is left of a range
are the places of the window in the shard. Windows that follow each other on both sides join to the
longest verbatim matches.

The order of words is that of their hashes. The work of a shard is its own sort and the searches,
most of which end after two or three words; benchmark words are never sorted with a shard.

The benchmark's words are hashed in tasks and read in blocks of at most ``block_words`` words; one
block is broadcast at a time, so memory does not grow with the benchmark. Shards do not interact:
nothing is shuffled unless there is more than one block.

A null text has no words. An item without words matches nothing; an item shorter than the window is
matched whole. Repeated documents each get their row and repeated items count each by its id. Rows go by
a digest of id and text, so rows without an id and different texts of one id stay apart. Empty
tables give an empty result, or documents without hits. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.shuffle import keyed
from causeway.llm.tokens import ALNUM, Words, chunks, words
from causeway.session import write_layer

WINDOW = 10
SHARD_BYTES = 1 << 22
BLOCK_WORDS = 4_000_000


def word_hashes(w: Words) -> np.ndarray:
    """Hashes of words; never 0, which separates texts."""
    h = w.hashes()
    h[h == 0] = 1
    return h


@dataclass
class Block:
    """Benchmark items: word hashes of all items one after the other, where each begins, and the words as places in ``names``."""

    ids: list[str]
    hashes: np.ndarray
    first: np.ndarray
    names: np.ndarray = field(init=False)
    code: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.names, code = np.unique(self.hashes, return_inverse=True)
        self.code = code.astype(np.int32)


def hashed(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words): the word hashes of each item, eight bytes a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                w = words(c, ALNUM, lower=True)
                bounds = pa.py_buffer((w.first * 8).astype(np.int64).tobytes())
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), c.hi - c.lo, [None, bounds, pa.py_buffer(word_hashes(w).tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, c.hi - c.lo), blobs.cast(pa.binary())], names=["item", "words"])
    return (benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
            .mapInArrow(run, "item string, words binary").where("length(words) > 0"))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks: the driver holds one block and one partition of hashes."""
    ids, parts, total = [], [], 0

    def block() -> Block:
        return Block(ids, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
    for row in hashed(benchmark, id_col, text_col).toLocalIterator():
        h = np.frombuffer(row["words"], np.uint64)
        if parts and total + len(h) > block_words:
            yield block()
            ids, parts, total = [], [], 0
        ids.append(row["item"])
        parts.append(h)
        total += len(h)
    if parts:
        yield block()


def shifted(rank: np.ndarray, by: int) -> np.ndarray:
    """Rank of what follows ``by`` words on; that of the separator beyond the end."""
    return np.concatenate([rank[by:], np.zeros(min(by, len(rank)), np.int64)])


def suffix_array(sequence: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct words, the place of each word in these, and all suffixes in the order of their first ``depth`` words."""
    vocabulary, word = np.unique(sequence, return_inverse=True)
    rank, key, done, span = word.astype(np.int64), None, 0, 1
    while 2 * span <= depth:  # rank: of the first ``span`` words; key: of the first ``done`` words
        if depth & span:
            part = shifted(rank, done)
            key = part if key is None else np.unique(key << 32 | part, return_inverse=True)[1]
            done += span
        rank = np.unique(rank << 32 | shifted(rank, span), return_inverse=True)[1]
        span *= 2
    last = shifted(rank, done)
    return vocabulary, word, np.argsort(last if key is None else key << 32 | last)


def bound(column: np.ndarray, places: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
    """For each range of suffixes, the first one whose word in ``column`` is not below ``want``."""
    lo, hi = lo.copy(), hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        less = column[places[mid]] < want[live]
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]
        live = live[lo[live] < hi[live]]
    return lo


@dataclass
class Matches:
    """Training word positions where a window of ``length`` words of ``item`` occurs; ``place`` is where in the item."""

    position: np.ndarray
    item: np.ndarray
    place: np.ndarray
    length: np.ndarray


def search(sequence: np.ndarray, block: Block, window: int) -> Matches:
    """Matches of the block's windows in a shard's word hashes (0 separates texts)."""
    vocabulary, word, places = suffix_array(sequence, window)
    word = np.concatenate([word, np.zeros(window, np.int64)])
    at = np.minimum(np.searchsorted(vocabulary, block.names), len(vocabulary) - 1)
    known = np.where(vocabulary[at] == block.names, at, -1)
    size = np.diff(block.first)
    ask = np.flatnonzero(known[block.code] >= 0)  # test suffixes whose first word the shard has
    item = np.searchsorted(block.first, ask, "right") - 1
    whole = ask + np.minimum(size, window)[item] <= block.first[item + 1]
    ask, item = ask[whole], item[whole]
    starts = np.searchsorted(word[places], np.arange(len(vocabulary) + 1))
    code = known[block.code[ask]]
    lo, hi = starts[code], starts[code + 1]
    found: list[tuple[np.ndarray, ...]] = []
    for depth in range(1, window + 1):
        full = np.minimum(size, window)[item] == depth
        count = (hi - lo)[full]
        which = np.repeat(np.flatnonzero(full), count)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        found.append((places[lo[which] + nth], item[which], ask[which] - block.first[item[which]], np.full(len(which), depth)))
        ask, item, lo, hi = (v[~full] for v in (ask, item, lo, hi))
        want = known[block.code[ask + depth]]
        ask, item, lo, hi, want = (v[want >= 0] for v in (ask, item, lo, hi, want))
        column = word[depth:]
        lo, hi = bound(column, places, lo, hi, want), bound(column, places, lo, hi, want + 1)
        ask, item, lo, hi = (v[lo < hi] for v in (ask, item, lo, hi))
    return Matches(*[np.concatenate(x) for x in zip(*found)])


def longest(m: Matches) -> np.ndarray:
    """Full length of each match: a match goes on as far as windows follow each other in the text and in the item."""
    order = np.lexsort((m.position, m.position - m.place, m.item))
    position, place, item = m.position[order], m.place[order], m.item[order]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(position) != 1) | (np.diff(place) != 1) | (np.diff(item) != 0)
    ends = np.append(np.flatnonzero(new)[1:], len(order))
    out = m.length.copy()
    out[order] += ends[np.cumsum(new) - 1] - 1 - np.arange(len(order))
    return out


def scan(docs: DataFrame, block: Block, window: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n_words, start, length, place, longest, item): every document, with the matches of one block."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in batches:
            for c in chunks(b.column(2), SHARD_BYTES):
                w = words(c, ALNUM, lower=True)
                h, rows = word_hashes(w), c.hi - c.lo
                spaced = np.zeros(len(h) + rows, np.uint64)
                home = np.arange(len(h)) + w.row
                spaced[home] = h
                m = search(spaced, block, window)
                full = longest(m)
                owner = np.full(len(spaced), -1)
                owner[home] = w.row
                row = owner[m.position]
                offset = m.position - row - w.first[row]
                order = np.lexsort((m.item, offset, row))
                bounds = np.searchsorted(row[order], np.arange(rows + 1)).astype(np.int32)

                def per_row(v: np.ndarray, kind: pa.DataType) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(v[order], kind))
                names = np.array(block.ids, object)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(c.lo, rows), b.column(1).slice(c.lo, rows), pa.array(np.diff(w.first), pa.int64()),
                    per_row(offset, pa.int32()), per_row(m.length, pa.int32()), per_row(m.place, pa.int32()), per_row(full, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(names[m.item[order]], pa.string()))],
                    names=["row", "doc_id", "n_words", "start", "length", "place", "longest", "item"])
    kind = docs.schema[id_col].dataType.simpleString()
    return keyed(docs, id_col, text_col).mapInArrow(
        run, f"row binary, doc_id {kind}, n_words bigint, start array<int>, length array<int>, place array<int>, longest array<int>, item array<string>")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document with its verbatim matches, as arrays: ``start`` (word), ``length`` (window),
    ``place`` (word in the item), ``longest`` (full length of the match) and ``item``.

    ``row`` is a digest of id and text; with more than one block, the blocks' rows are merged by it.
    """
    parts = [scan(docs, block, window, id_col, text_col) for block in blocks(benchmark, item_col, item_text_col, block_words)]
    if not parts:
        parts = [scan(docs, Block([], np.zeros(0, np.uint64), np.zeros(1, np.int64)), window, id_col, text_col)]
    if len(parts) == 1:
        return parts[0]
    rows = write_layer(parts[0], "matches-0").withColumn("block", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        rows = rows.unionByName(write_layer(part, f"matches-{k}").withColumn("block", F.lit(k)))
    lists = ["start", "length", "place", "longest", "item"]
    # rows that repeat id and text have equal matches: those of one row of each block, as often as the row occurs
    per = (rows.groupBy("row", "block").agg(F.count(F.lit(1)).alias("_n"), F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first(F.struct(*lists)).alias("m"))
           .groupBy("row").agg(F.max("_n").alias("_n"), F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                               *[F.flatten(F.collect_list(F.col(f"m.{c}"))).alias(c) for c in lists]))
    return per.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("row", "doc_id", "n_words", *lists)


def summary(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) from ``matches``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_hit, n_items, digest = [], [], []
            starts, lengths, items = b.column(2), b.column(3), b.column(4)
            for k in range(b.num_rows):
                s = starts[k].values.to_numpy()
                e = s + lengths[k].values.to_numpy()
                order = np.argsort(s, kind="stable")
                s, e = s[order], e[order]
                reach = np.maximum.accumulate(np.concatenate([[0], e]))[:-1] if len(s) else s
                n_hit.append(int(np.maximum(0, e - np.maximum(s, reach)).sum()))
                names = sorted(set(items[k].values.to_pylist()))
                n_items.append(len(names))
                digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()),
                                              pa.array(digest, pa.string())],
                                             names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "n_words", "start", "length", "item").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string").withColumn("contaminated", F.col("n_hit") > 0)
