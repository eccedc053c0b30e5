"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find.

1. A document's set is its distinct 5-word shingles (words split at ASCII white space, A-Z lowered);
   fewer words than that are one shingle. Equal sets form one class and go on as one document.
2. SuperMinHash: for every element a random permutation of the signature's slots is drawn step by
   step, and slot p_j gets the least of r_j + j. Later steps give larger values, so a document stops
   as soon as all its slots are filled; for long documents that is the first step.
3. Banding: classes that agree on all rows of a band are tied to the smallest class of that bucket,
   one tie for each member. The connected groups of ties contain every pair that shares a bucket.
4. Verification: a group is cut into blocks of bounded size by hash; each pair of blocks compares
   full sets by counting shared shingles in a matrix product, and gives back a spanning forest of
   its links, never all pairs.
5. Union-find over the links gives the components.

Recall: a pair at similarity 0.85 shares none of the 28 bands of 6 rows with probability 2e-6, one
at 0.9 with 2e-10. No bucket, group or candidate list is capped. The pairs of blocks of one group
grow with the square of its *different* texts; equal texts cost nothing.

Null, empty and blank texts have an empty set: a component of their own. Repeated rows of a
document id count as one document each and are linked through equal sets, and so do different
texts of one id; a group's id is the least that is not null. Rows without an id are kept where no document
with an id stands for them. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.graph import components
from causeway.llm.shuffle import keyed, packed, sorted_groups, unpack
from causeway.llm.tokens import U64, Chunk, chunks, grams, inside, join, mix, words
from causeway.session import write_layer

SHINGLE = 5
BANDS = 28
ROWS = 6
BLOCK_DOCS = 128
BLOCK_BYTES = 1 << 22


def shingles(chunk: Chunk, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of the distinct shingles of each row, in row order."""
    w = words(chunk, lower=True)
    h = w.hashes()
    size = np.diff(w.first)
    g = grams(h, n)
    row, ok = w.row, inside(w.first, n, len(g))
    out_row, out = [row[:len(g)][ok]], [g[ok]]
    for k in range(1, n):  # whole sequences of fewer words
        short = np.flatnonzero(size == k)
        if len(short):
            at = w.first[short]
            value = h[at]
            for j in range(1, k):
                value = join(value, h[at + j])
            out_row.append(short)
            out.append(join(value, np.full(len(short), k, U64)))
    row, value = np.concatenate(out_row), np.concatenate(out)
    seen = mix(value + mix(row.astype(U64)))
    order = np.argsort(seen)
    again = np.zeros(len(seen), bool)
    again[order[1:]] = seen[order[1:]] == seen[order[:-1]]
    row, value = row[~again], value[~again]
    order = np.argsort(row, kind="stable")
    return row[order], value[order]


def superminhash(row: np.ndarray, element: np.ndarray, rows: int, slots: int, part: int = 50_000) -> np.ndarray:
    """Signatures (rows x slots); infinite for rows without elements. ``row`` is sorted."""
    best = np.full(rows * slots, np.inf)
    count = np.bincount(row, minlength=rows)
    ends = np.cumsum(count)
    lo = 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + part, side="right")))
        a, b = (ends[lo - 1] if lo else 0), ends[hi - 1]
        r, e = row[a:b], element[a:b]
        order = None
        for j in range(slots):
            if not len(e):
                break
            draw = mix(e + U64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            value = (draw >> U64(11)).astype(np.float64) * 2.0 ** -53 + j
            k = j + ((draw & U64(0x7FFFFFFF)) % U64(slots - j)).astype(np.int64)
            if order is None:
                slot = k
            else:
                me = np.arange(len(e))
                slot = order[me, k].astype(np.int64)
                order[me, k] = order[:, j]
            np.minimum.at(best, r * slots + slot, value)
            open_rows = np.isinf(best[lo * slots:hi * slots].reshape(-1, slots)).any(1)
            keep = open_rows[r - lo]
            if order is None:
                r, e, k = r[keep], e[keep], k[keep]
                order = np.broadcast_to(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(e), slots)).copy()
                order[np.arange(len(e)), k] = 0
            elif not keep.all():
                r, e, order = r[keep], e[keep], order[keep]
        lo = hi
    return best.reshape(rows, slots)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(row, doc_id, n_shingles, set_a, set_b, bands): the set's size and 128-bit digest, and one key for each band. ``docs``: (row, doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(2)):
                n = c.hi - c.lo
                row, value = shingles(c)
                size = np.bincount(row, minlength=n)
                digest = []
                for salt in (1, 2):
                    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(value ^ U64(salt * 0xA24BAED4963EE407 & (1 << 64) - 1)))])
                    ends = np.cumsum(size)
                    digest.append((total[ends] - total[ends - size]).view(np.int64))
                slot = superminhash(row, value, n, bands * rows).view(U64).reshape(n, bands, rows)
                key = np.tile(np.arange(bands, dtype=U64), (n, 1))
                for k in range(rows):
                    key = join(key, slot[:, :, k])
                flat = pa.array(key.view(np.int64).reshape(-1))
                bounds = pa.array((np.arange(n + 1) * bands).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.lo, n), b.column(1).slice(c.lo, n), pa.array(size.astype(np.int64)), pa.array(digest[0]), pa.array(digest[1]), pa.ListArray.from_arrays(bounds, flat)],
                    names=["row", "doc_id", "n_shingles", "set_a", "set_b", "bands"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"row binary, doc_id {kind}, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")


def ties(classes: DataFrame) -> DataFrame:
    """(a, b): each class and the smallest class of a bucket it is in. ``classes``: (doc_id, bands)."""
    keys = classes.select("doc_id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keys.join(buckets, "key").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()


def linked(shared: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (size[:, None] + size[None, :] - shared)


def forest(link: np.ndarray) -> np.ndarray:
    """Smallest index that each index reaches over the links."""
    label = np.arange(len(link))
    while True:
        near = np.where(link, label[None, :], len(link)).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(row: np.ndarray, value: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Links between n documents from their (row, shingle) pairs; always with itself."""
    size = np.bincount(row, minlength=n).astype(np.int64)
    names, code, count = np.unique(value, return_inverse=True, return_counts=True)
    common = count[code] > 1
    row, code = row[common], (np.cumsum(count > 1) - 1)[code[common]]
    shared = np.zeros((n, n))
    width = int((count > 1).sum())
    step = max(256, (1 << 22) // max(n, 1))
    for a in range(0, width, step):
        mine = (code >= a) & (code < a + step)
        matrix = np.zeros((n, min(step, width - a)), np.float32)
        matrix[row[mine], code[mine] - a] = 1
        shared += matrix @ matrix.T
    shared[np.arange(n), np.arange(n)] = size
    return linked(shared.astype(np.int64), size, percent) & (size[:, None] > 0)


def verified(docs: DataFrame, groups: DataFrame, percent: int, id_col: str, text_col: str,
             block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b): links that span what is linked inside each group. ``groups``: (doc_id, component, n_shingles)."""
    kind = docs.schema[id_col].dataType.simpleString()
    weight = F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum("n_shingles") * 8 / block_bytes)).cast("int")
    sizes = groups.groupBy("component").agg(weight.alias("blocks"))
    placed = (groups.join(sizes, "component")
              .select(F.col("doc_id"), "component", "blocks", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("blocks")).cast("int").alias("block")))
    # the placed documents grow with the corpus, so this side is never to be broadcast
    texts = packed(docs, id_col, text_col).join(placed.hint("merge"), "doc_id").dropDuplicates(["doc_id"])
    pairs = (texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "z",
                     F.length("z").cast("long").alias("bytes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in sorted_groups(batches, 3, size="bytes", max_size=1 << 20):
            table = table.combine_chunks()
            ids = table.column("doc_id")
            rows, values = [], []
            for c in chunks(unpack(table.column("z").chunk(0))):
                r, v = shingles(c)
                rows.append(r + c.lo)
                values.append(v)
            row, value = np.concatenate(rows), np.concatenate(values)
            cut = np.searchsorted(row, bounds)
            left, right = [], []
            for g in range(len(bounds) - 1):
                n = int(bounds[g + 1] - bounds[g])
                if n > 1:
                    label = forest(compare(row[cut[g]:cut[g + 1]] - bounds[g], value[cut[g]:cut[g + 1]], n, percent))
                    member = np.flatnonzero(label != np.arange(n))
                    left.append(label[member] + bounds[g])
                    right.append(member + bounds[g])
            if left:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(x))).combine_chunks() for x in (left, right)], names=["a", "b"])
    return pairs.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text",
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept). Links: 100 * intersection >= percent * union."""
    docs = keyed(docs, id_col, text_col)
    signed = write_layer(signatures(docs, bands, rows), "near-signatures")
    filled = signed.where("n_shingles > 0")
    # classes are named by one of their rows, which is never null; the least id passes over nulls
    classes = write_layer(filled.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("row", "bands")).alias("x"), F.min("doc_id").alias("least"))
                          .select("set_a", "set_b", "n_shingles", "least", F.col("x.row").alias("doc_id"), "x.bands"), "near-classes")
    groups = components(ties(classes), "near-ties").select(F.col("node").alias("doc_id"), "component")
    groups = write_layer(groups.join(classes.select("doc_id", "n_shingles"), "doc_id"), "near-groups")
    links = components(verified(docs, groups, percent, "row", "text"), "near-links")
    smallest = (links.join(classes.select("doc_id", "least"), F.col("node") == F.col("doc_id")).groupBy("component").agg(F.min("least").alias("smallest")))
    links = links.join(smallest, "component").select("node", "smallest")
    label = (classes.select("set_a", "set_b", "doc_id", "least").join(links, F.col("doc_id") == F.col("node"), "left")
             .select("set_a", "set_b", F.coalesce("smallest", "least").alias("component_id")))
    # one row for each set on the right: a set that many documents share is split by the adaptive skew join
    known = filled.join(label, ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
