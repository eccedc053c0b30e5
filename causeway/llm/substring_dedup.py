"""Substring deduplication by minimiser groups of suffixes over words, in place of prefix-partitioned suffix trees.

A suffix begins at every word that has ``window`` words of its document from there on, and is read
``window`` words deep: two suffixes that agree so far meet in an internal node of that depth, and
everything such a node covers is a repeat. The suffixes are split into groups that fit a task:

1. Each suffix carries the first least of the hashed 8-word sequences in its window (its anchor).
   Equal windows have equal anchors, so a suffix whose anchor occurs once in the corpus cannot
   repeat and goes no further. Consecutive suffixes with one anchor travel as one piece of text.
2. Pieces are grouped by the anchor's 8 words, which stand anywhere in the window (a minimiser, not a prefix). A group of at most ``group_pieces`` pieces gives one
   subtree: its suffixes are sorted by prefix doubling, and equal neighbours at full depth are the
   leaves of a deep internal node.
3. A larger group is split by whole prefixes. As every leaf pair in question agrees on all of its
   ``window`` words, the prefix is extended to just that length (128-bit digests): each group is
   then a single node, and counting its leaves replaces the subtree. The group's pieces are dealt
   out in blocks first: what repeats inside a block is found by the block's own subtree, and a block
   sends each prefix once with its count, so a passage shared by a third of all documents is no hot
   spot; only a prefix that is single in its block waits for the counts of the others.

Texts with the same words stand for one class; if it has two members or more, all of its windows
repeat and only its first member takes part in the search for the others.

Null and blank texts have no words; texts of fewer words than the window lose nothing. Repeated
rows repeat each other's windows; rows without an id, and different texts of one id, are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.shuffle import keyed, packed, sorted_groups, unpack
from causeway.llm.tokens import U64, Chunk, Words, chunks, grams, inside, mix, words
from causeway.session import write_layer

WINDOW = 35
ANCHOR = 8
GROUP_PIECES = 32_768
_PLACE = 30


def anchors(w: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, first, last): runs of windows first..last (word positions) that share an anchor, in text order."""
    none = np.zeros(0, np.int64)
    g = grams(h, ANCHOR)
    span = window - ANCHOR + 1
    if len(g) < span:
        return none, np.zeros(0, U64), none, none
    low = ((g >> U64(_PLACE)) << U64(_PLACE)) | np.arange(len(g), dtype=U64)
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:len(g) - span + 1], low[span - size:][:len(g) - span + 1])
    start = np.flatnonzero(inside(w.first, window, len(low)))
    if not len(start):
        return none, np.zeros(0, U64), none, none
    at = (low[start] & U64((1 << _PLACE) - 1)).astype(np.int64)
    row = w.row[start]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return row[begin], g[at[begin]], start[begin], start[end]


def plain(text: bytes) -> bytes:
    """The words joined by one space."""
    return b" ".join(text.split())


def surveyed(docs: DataFrame, window: int) -> DataFrame:
    """(row, doc_id, n_words, digest, keys): whole-text digest of the words, and the anchors in text order. ``docs``: (row, doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(2)):
                w = words(c)
                row, key, _, _ = anchors(w, w.hashes(), window)
                bounds = np.searchsorted(row, np.arange(c.hi - c.lo + 1)).astype(np.int32)
                digest = [hashlib.sha256(plain(c.data[x:y].tobytes())).digest() for x, y in zip(c.offsets[:-1], c.offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.lo, c.hi - c.lo), b.column(1).slice(c.lo, c.hi - c.lo), pa.array(np.diff(w.first)), pa.array(digest, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(key.view(np.int64)))], names=["row", "doc_id", "n_words", "digest", "keys"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"row binary, doc_id {kind}, n_words bigint, digest binary, keys array<bigint>")


def texts_of(table: pa.Table) -> Iterator[tuple[Chunk, Words, np.ndarray]]:
    for c in chunks(unpack(table.column("z"))):
        w = words(c)
        yield c, w, w.hashes()


def occurrences(survey: DataFrame) -> DataFrame:
    """(key, n, doc_id, place, docs, places): where anchors occur, as ordinals in their documents.

    The places that one batch of documents has of an anchor share a row, with lists where there is
    more than one. So a passage that stands in many documents costs a row for each batch of them.
    """
    kind = survey.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, size, key = b.column(0), np.diff(b.column(1).offsets.to_numpy()), b.column(1).flatten().to_numpy()
            order = np.argsort(key, kind="stable")
            row = np.repeat(np.arange(len(size)), size)[order]
            place = (np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size))[order]
            key = key[order]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
            n = np.diff(np.append(begin, len(key)))
            several, held = np.repeat(n > 1, n), np.where(n > 1, n, 0)
            bounds, single = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32)), pa.array(n == 1)
            lists = [pa.ListArray.from_arrays(bounds, v, mask=single) for v in (ids.take(pa.array(row[several])), pa.array(place[several]))]
            yield pa.RecordBatch.from_arrays([pa.array(key[begin]), pa.array(n), ids.take(pa.array(row[begin])), pa.array(place[begin]), *lists],
                                             names=["key", "n", "doc_id", "place", "docs", "places"])
    return survey.select("doc_id", "keys").mapInArrow(run, f"key bigint, n bigint, doc_id {kind}, place bigint, docs array<{kind}>, places array<bigint>")


def suspects(survey: DataFrame, group_pieces: int) -> DataFrame:
    """(doc_id, at, blocks): ordinals of the anchors that occur twice or more, and into how many blocks their group is to be cut."""
    rows = occurrences(survey)
    counts = rows.groupBy("key").agg(F.sum("n").alias("total")).where("total > 1")
    places = F.arrays_zip(F.coalesce("docs", F.array("doc_id")).alias("doc_id"), F.coalesce("places", F.array("place")).alias("place"))
    hit = (rows.join(counts, "key").select(F.ceil(F.col("total") / group_pieces).cast("int").alias("blocks"), F.explode(places).alias("p"))
           .select("p.doc_id", F.col("p.place").cast("int").alias("at"), "blocks"))
    return hit.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "blocks"))).alias("s")).select("doc_id", F.col("s.at").alias("at"), F.col("s.blocks").alias("blocks"))


def pieces(docs: DataFrame, found: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Texts of the runs of suspect suffixes: (key, doc_id, start, blocks, text)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, blocks = b.column(0), b.column(2), b.column(3)
            for c in chunks(unpack(b.column(1))):
                w = words(c)
                row, key, first, last = anchors(w, w.hashes(), window)
                begin = np.searchsorted(row, np.arange(c.hi - c.lo))
                mine = at.slice(c.lo, c.hi - c.lo)
                pick = np.repeat(begin, np.diff(mine.offsets.to_numpy())) + mine.flatten().to_numpy()
                data = c.data.tobytes()
                text = [data[x:y] for x, y in zip(w.start[first[pick]].tolist(), w.end[last[pick] + window - 1].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[pick].view(np.int64)), ids.take(pa.array(row[pick] + c.lo)), pa.array(first[pick] - w.first[row[pick]]),
                     blocks.slice(c.lo, c.hi - c.lo).flatten(), pa.array(text, pa.binary())], names=["key", "doc_id", "start", "blocks", "text"])
    texts = packed(docs, id_col, text_col).join(found.hint("merge"), "doc_id").dropDuplicates(["doc_id"])  # both grow with the corpus
    return texts.select("doc_id", "z", "at", "blocks").mapInArrow(run, f"key bigint, doc_id {kind}, start bigint, blocks int, text binary")


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, made a chunk at a time, and where each text's begin (with the end)."""
    parts, sizes = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    for c in chunks(column):
        w = words(c)
        parts.append(w.hashes())
        sizes.append(np.diff(w.first))
    return np.concatenate(parts), np.cumsum(np.concatenate(sizes))


def depth_nodes(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, node): suffixes of the pieces whose first ``window`` words others have too, by sorting the subtree's suffixes."""
    size = np.diff(first)
    spaced = np.zeros(len(h) + len(size), np.int32)
    home = np.arange(len(h)) + np.repeat(np.arange(len(size)), size)
    spaced[home] = np.unique(h, return_inverse=True)[1] + 1
    level, span = spaced, 1
    needed = {1: level} if window & 1 else {}
    while span * 2 <= window:
        pair = level.astype(np.int64) << 32
        pair[:-span] |= level[span:]
        level = np.unique(pair, return_inverse=True)[1].astype(np.int32)
        span *= 2
        if window & span:
            needed[span] = level
    suffix = np.flatnonzero(inside(first, window, len(h)))
    at, rank = home[suffix], None
    done = 0
    for span in sorted(needed, reverse=True):
        part = needed[span][at + done]
        rank = part if rank is None else np.unique((rank.astype(np.int64) << 32) | part, return_inverse=True)[1]
        done += span
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    leaf = np.zeros(len(order), bool)
    leaf[1:] = ranked[1:] == ranked[:-1]
    leaf[:-1] |= ranked[1:] == ranked[:-1]
    keep = np.sort(order[leaf])
    return suffix[keep], rank[keep]


def spans_of(start: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, begin, end): runs of consecutive windows as word ranges."""
    if not len(start):
        return owner, start, start
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    return owner[begin], start[begin], start[np.append(begin[1:], len(start)) - 1] + window


def repeats(docs: DataFrame, survey: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
            group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, begin, end): word ranges covered by windows that start elsewhere too, among the documents of ``survey``."""
    kind = docs.schema[id_col].dataType.simpleString()
    parts = write_layer(pieces(docs, suspects(survey, group_pieces), window, id_col, text_col), "substring-pieces")

    def subtree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in sorted_groups(batches, 1, size="bytes", max_size=1 << 21):
            table = table.combine_chunks()
            h, first = hashed(table.column("text").chunk(0))
            suffix, _ = depth_nodes(h, first, window)
            row, begin, end = spans_of(suffix, np.searchsorted(first, suffix, side="right") - 1, window)
            shift = table.column("start").to_numpy()[row] - first[row]
            yield pa.RecordBatch.from_arrays([table.column("doc_id").take(pa.array(row)).combine_chunks(), pa.array(begin + shift), pa.array(end + shift)],
                                             names=["doc_id", "begin", "end"])
    small = parts.where("blocks = 1").select("key", "doc_id", "start", "text", F.length("text").cast("long").alias("bytes"))
    grouped = small.repartition("key").sortWithinPartitions("key").mapInArrow(subtree, f"doc_id {kind}, begin bigint, end bigint")

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["prefix_a", "prefix_b", "n", "doc_id", "begin", "end"]
        for table, _ in sorted_groups(batches, 2, size="bytes", max_size=1 << 21):
            table = table.combine_chunks()
            ids, start = table.column("doc_id").chunk(0), table.column("start").to_numpy()
            h, first = hashed(table.column("text").chunk(0))
            suffix, _ = depth_nodes(h, first, window)
            row, begin, end = spans_of(suffix, np.searchsorted(first, suffix, side="right") - 1, window)
            none, shift = pa.array(np.zeros(len(row), np.int64)), start[row] - first[row]
            yield pa.RecordBatch.from_arrays([none, none, none, ids.take(pa.array(row)), pa.array(begin + shift), pa.array(end + shift)], names=names)
            g, other = grams(h, window), grams(mix(h ^ U64(0x5851F42D4C957F2D)), window)
            at = np.flatnonzero(inside(first, window, len(g)))
            at = at[np.lexsort((other[at], g[at]))]
            new = np.ones(len(at), bool)
            new[1:] = (g[at[1:]] != g[at[:-1]]) | (other[at[1:]] != other[at[:-1]])
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(at)))
            at = at[head]
            row, several = np.searchsorted(first, at, side="right") - 1, n > 1
            place = at + start[row] - first[row]
            yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(other[at].view(np.int64)), pa.array(n), ids.take(pa.array(row, mask=several)),
                                              pa.array(place, mask=several), pa.array(place + window, mask=several)], names=names)
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block")
    large = (parts.where("blocks > 1").select("key", block, "doc_id", "start", "text", F.length("text").cast("long").alias("bytes"))
             .repartition("key", "block").sortWithinPartitions("key", "block")
             .mapInArrow(extended, f"prefix_a bigint, prefix_b bigint, n bigint, doc_id {kind}, begin bigint, end bigint"))
    large = write_layer(large, "substring-leaves")
    prefix = ["prefix_a", "prefix_b"]
    nodes = large.where("n > 0").groupBy(*prefix).agg(F.sum("n").alias("leaves")).where("leaves > 1").drop("leaves")
    apart = large.where("n = 1").join(nodes, prefix)
    spans = ["doc_id", "begin", "end"]
    return grouped.unionByName(large.where("n = 0").select(*spans)).unionByName(apart.select(*spans))


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the words in the ranges, each with the white space after it; how many words went."""
    c = next(chunks(pa.array([text], pa.binary())))
    w = words(c)
    keep = np.ones(len(w.start), bool)
    for a, b in spans:
        keep[a:b] = False
    # a word's bytes reach up to the next word
    reach = np.append(w.start[1:], len(w.data))
    mark = np.zeros(len(w.data) + 1, np.int64)
    np.add.at(mark, w.start[~keep], 1)
    np.add.at(mark, reach[~keep], -1)
    return w.data[np.cumsum(mark)[:-1] == 0].tobytes(), int((~keep).sum())


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES,
          with_text: bool = False) -> DataFrame:
    """One row per document: (doc_id, n_words, n_removed, kept_sha256), with the kept text if asked for.

    The text of a document that loses nothing stays as it is; else the kept words keep their white space.
    """
    docs = keyed(docs, id_col, text_col)
    survey = write_layer(surveyed(docs, window), "substring-survey")
    classes = survey.where(F.col("n_words") >= window).groupBy("digest").agg(F.min("row").alias("doc_id"), F.count(F.lit(1)).alias("members"))
    classes = write_layer(classes, "substring-classes")
    # from here on rows go by their own key, and meet their ids again in the result
    apart = survey.select(F.col("row").alias("doc_id"), "keys").join(classes.select("doc_id"), "doc_id").dropDuplicates(["doc_id"])
    alone = classes.where("members = 1").select("doc_id")
    spans = (repeats(docs, apart, window, "row", "text", group_pieces).join(alone, "doc_id", "left_semi")
             .groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans")))
    spans = write_layer(spans, "substring-spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone, digest = [], [], []
            for z, s in zip(unpack(b.column(1)), b.column(2)):
                v = s.values
                text, n = cut(z.as_py(), list(zip(v.field(0).to_pylist(), v.field(1).to_pylist())))
                texts.append(text.decode("utf-8", "replace") if with_text else "")
                gone.append(n)
                digest.append(hashlib.sha256(plain(text)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string())],
                                             names=["row", "removed", "sha", "kept_text"])
    changed = packed(docs, "row", "text").join(spans, "doc_id").mapInArrow(run, "row binary, removed bigint, sha string, kept_text string")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    # one row for each digest on the right: a text that many documents share is split by the adaptive skew join
    copies = classes.where("members > 1").select("digest", F.lit(True).alias("copied"))
    out = (survey.select("row", "doc_id", "n_words", "digest").join(copies, "digest", "left").join(changed.dropDuplicates(["row"]), "row", "left"))
    copied = F.col("copied").isNotNull()
    out = out.select("doc_id", "n_words", F.when(copied, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
                     F.when(copied, empty).otherwise(F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256"),
                     *([F.when(copied, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []))
    return out
