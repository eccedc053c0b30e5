"""SimHash near-duplicates by anchor-point covering.

1. A document's shingles are its sequences of 3 words (split at ASCII white space, A-Z lowered, joined
   by one space), repeats included; fewer words are one shingle, no words are none. A bit of the
   64-bit fingerprint is 1 if it is set in over half of the shingles' XXH64 values (UTF-8, seed 42).
   Documents of one fingerprint go on as one.
2. The anchors are the words of a covering code, a direct sum of block codes. Every fingerprint is at
   home at its nearest anchor (the least block words on ties), at distance e, at most the covering radius.
3. It is replicated to every anchor within e + 3, so within covering radius plus threshold. Of two
   fingerprints at distance 3 or less, let x be the one with the smaller e and c its home: the other is
   within 3 + e(x) <= 3 + e(y) of c, so both meet at c. No link is lost, whatever the ties.
4. At each anchor those at home are compared with all that came. Large anchors are cut into cells of
   bounded size by hash; a cell gives back a spanning forest of its links, never all pairs.
5. Union-find over the links gives the components.

A larger code has fewer fingerprints at an anchor and more copies of each. ``CODES`` lists three, and the
first whose anchors hold few enough fingerprints on average serves; all give the same links.

Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows and
different texts of one id give a row each; a component's id is the least that is not null (null where
no member has an id). An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.graph import components
from causeway.llm.shuffle import sorted_groups
from causeway.llm.spaced import grams_of, respaced
from causeway.llm.tokens import SPACED, U64, Chunk, chunks, words
from causeway.session import write_layer

SHINGLE = 3
BITS = 3
SEED = 42
CELL = 2048
#: An anchor may hold this many fingerprints on average before a larger code is taken.
CROWD = 1 << 15


def fingerprints_of(chunk: Chunk, n: int = SHINGLE, seed: int = SEED, part: int = 1 << 16) -> np.ndarray:
    """One fingerprint for each row of a chunk."""
    w = words(chunk, lower=True)
    data, start, end = respaced(w, SPACED)
    first, last, row = grams_of(w.first, n, short=True)
    buffer, digest = data.tobytes(), xxhash.xxh64_intdigest
    rows = len(w.first) - 1
    votes, total = np.zeros((rows, 64), np.int64), np.bincount(row, minlength=rows)
    for lo in range(0, len(row), part):
        a, b, r = start[first[lo:lo + part]].tolist(), end[last[lo:lo + part]].tolist(), row[lo:lo + part]
        h = np.array([digest(buffer[i:j], seed) for i, j in zip(a, b)], U64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begin = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        votes[r[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > total[:, None], axis=1, bitorder="little").view(U64).reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row, as a signed 64-bit integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, c.hi - c.lo), pa.array(fingerprints_of(c, n, seed).view(np.int64))], names=["doc_id", "fp"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def reed_muller() -> np.ndarray:
    """The 64 words of the first-order Reed-Muller code of length 32 (covering radius 12)."""
    rows = [0xFFFFFFFF] + [sum(1 << x for x in range(32) if x >> k & 1) for k in range(5)]
    return span(rows)


def golay() -> np.ndarray:
    """The 4,096 words of the perfect Golay code of length 23 (covering radius 3)."""
    return span([0xC75 << k for k in range(12)])


def span(rows: list[int]) -> np.ndarray:
    out = np.zeros(1, U64)
    for r in rows:
        out = np.concatenate([out, out ^ U64(r)])
    return np.sort(out)


@dataclass(frozen=True)
class Code:
    """A direct sum: ``blocks`` are (first bit, length, words); bits in no block count for nothing. ``copies``: anchors
    that a random fingerprint is replicated to, on average."""

    blocks: tuple[tuple[int, int, np.ndarray], ...]
    copies: int

    @property
    def anchors(self) -> int:
        return int(np.prod([len(w) for _, _, w in self.blocks]))

    def reach(self, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the fingerprint, anchor, at home): every anchor within its own distance to the code plus ``threshold``."""
        row, anchor, excess = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64)
        home = np.ones(len(fp), bool)
        for first, length, code in self.blocks:
            part = fp >> U64(first) & U64((1 << length) - 1)
            distance = np.bitwise_count(part[:, None] ^ code[None, :])
            more = distance - distance.min(1)[:, None]
            nearest = more.argmin(1)
            who, word = np.nonzero(more <= threshold)
            begin = np.searchsorted(who, np.arange(len(fp) + 1))
            count = np.diff(begin)[row]
            at = np.repeat(begin[row] - np.cumsum(count) + count, count) + np.arange(count.sum())
            row, excess, anchor, home = (np.repeat(x, count) for x in (row, excess, anchor, home))
            excess = excess + more[row, word[at]]
            keep = excess <= threshold
            row, excess, word = row[keep], excess[keep], word[at][keep]
            anchor, home = anchor[keep] * len(code) + word, home[keep] & (word == nearest[row])
        return row, anchor, home


#: Smallest first.
CODES = (Code(((0, 32, reed_muller()), (32, 32, reed_muller())), 29),
         Code(((0, 23, golay()), (23, 32, reed_muller())), 166),
         Code(((0, 23, golay()), (23, 23, golay())), 265))


def choose(prints: int, crowd: int = CROWD) -> Code:
    return next((c for c in CODES if prints * c.copies / c.anchors <= crowd), CODES[-1])


def replicas(prints: DataFrame, code: Code, threshold: int = BITS) -> DataFrame:
    """(anchor, fp, home) for every anchor that a fingerprint is replicated to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for lo in range(0, len(fp), 1024):
                part = fp[lo:lo + 1024]
                row, anchor, home = code.reach(part.view(U64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row]), pa.array(home)], names=["anchor", "fp", "home"])
    return prints.select("fp").mapInArrow(run, "anchor bigint, fp bigint, home boolean")


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes joined by the edges (a, b): the least node that each reaches."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        label = new[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def cell_links(fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one cell: those at home (``home``) with those that came (not ``home``)."""
    name, code = np.unique(fp, return_inverse=True)
    here, came = code[home], code[~home]
    left, right = [], []
    for lo in range(0, len(here), 256):
        near = np.bitwise_count((name[here[lo:lo + 256], None] ^ name[None, came]).view(U64)) <= threshold
        i, j = np.nonzero(near)
        left.append(here[lo + i])
        right.append(came[j])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    differ = a != b
    label = spanning(a[differ], b[differ], len(name))
    member = np.flatnonzero(label != np.arange(len(name)))
    return name[label[member]], name[member]


def links(prints: DataFrame, code: Code, threshold: int = BITS, cell: int = CELL) -> DataFrame:
    """(a, b): links that span all fingerprints at ``threshold`` or fewer differing bits."""
    copies = replicas(prints, code, threshold)
    # the fingerprints at an anchor, counted before the shuffle; only crowded anchors have more than one cell
    crowd = (copies.groupBy("anchor").agg(F.ceil(F.sum(F.col("home").cast("long")) / cell).alias("rows"), F.ceil(F.count(F.lit(1)) / cell).alias("cols"))
             .where("rows > 0 AND (rows > 1 OR cols > 1)"))
    placed = copies.join(crowd, "anchor", "left")
    rows, cols = F.coalesce("rows", F.lit(1)), F.coalesce("cols", F.lit(1))
    mine = F.xxhash64("fp", F.lit(5))
    came = placed.select("anchor", F.explode(F.sequence(F.lit(0), (rows - 1).cast("int"))).alias("i"), F.pmod(mine, cols).cast("int").alias("j"), "fp", F.lit(False).alias("home"))
    here = placed.where("home").select("anchor", F.pmod(mine, rows).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), (cols - 1).cast("int"))).alias("j"), "fp", "home")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in sorted_groups(batches, 3, max_size=1 << 16):
            fp, home = table.column("fp").to_numpy(), table.column("home").to_numpy()
            found = [cell_links(fp[a:b], home[a:b], threshold) for a, b in zip(bounds[:-1], bounds[1:]) if home[a:b].any() and not home[a:b].all()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])
    return (here.unionByName(came).repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(run, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = BITS, n: int = SHINGLE,
                    seed: int = SEED, code: Code | None = None) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id)."""
    signed = write_layer(fingerprints(docs, id_col, text_col, n, seed), "simhash-prints")
    prints = write_layer(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(prints, code or choose(prints.count()), threshold), "simhash-links")
    found = prints.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = found.groupBy("component").agg(F.min("least").alias("component_id"))
    label = found.join(smallest, "component").select("fp", "component_id")
    # one row for each fingerprint on the right: one that many documents share is split by the adaptive skew join
    return signed.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
