"""Language-model scoring by deleted interpolation.

P(w | u) = a * c(u,w)/c(u) + b * c(w)/N + (1 - a - b) / (V + 1), where a and b belong to the bucket
of the context's count c(u) (powers of two) and are learned by expectation-maximisation on held-out
counts: one fold of the training documents is deleted from the counts and scored with what is left.
Final scores use the counts of all training documents.

Counting is one shuffle. A scan task combines about ``SPAN_BYTES`` of text into a span, and sends the
span's distinct words and word pairs, as sorted hashes cut into hash ranges, each with its count in
the training and in the deleted part. The task of a hash range adds up the counts of all spans and
answers each span in the order it asked. A word or pair costs a span one entry however often it
occurs, so no word is a hot key, and what is gathered grows with the text. The answers are written
once; learning and scoring scan the texts again and meet the answers by span.

The learning pass sums held-out tokens on a grid (bucket, and both estimates to a quarter of an
octave), so what reaches the driver does not grow with the corpus.

A null or empty text consists of its end token. Repeated rows count as often as they occur. An empty
table gives an empty result; without training or deleted documents the weights are (0.6, 0.3, 0.1).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.shuffle import sorted_groups
from causeway.llm.tokens import U64, chunks, join, words
from causeway.session import write_layer

SPAN_BYTES = 6 << 20
END = U64(0xE7D0)
START = U64(0x57A7)
FOLDS, TEST_FOLD, DELETED_FOLD = 7, 2, 3
GRID = 4
DEFAULT = (0.6, 0.3)
BUCKETS = 48


def squeeze(values: np.ndarray) -> bytes:
    """Integers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return struct.pack("<I", len(values)) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(blob: bytes, dtype: type) -> np.ndarray:
    n = struct.unpack_from("<I", blob)[0]
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:], max_output_size=max(1, n * width)), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).reshape(n)


@dataclass
class Span:
    """A run of documents of one scan task: token hashes with an end token after each text."""

    number: int
    ids: pa.Array
    fold: np.ndarray
    texts: list[bytes]
    lengths: np.ndarray
    tokens: np.ndarray
    row: np.ndarray

    @property
    def begins(self) -> np.ndarray:
        return np.flatnonzero(np.diff(self.row, prepend=-1))

    def keys(self) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Sorted distinct words and word pairs, each with the index of every token in it."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.begins] = START
        return np.unique(self.tokens, return_inverse=True), np.unique(join(before, self.tokens), return_inverse=True)


def token_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """(lo, hi, tokens, row of each, bytes of each row, text) of the chunks of a column."""
    for c in chunks(column):
        w = words(c, lower=True)
        rows = c.hi - c.lo
        tokens = np.full(len(w.start) + rows, END, U64)
        tokens[np.arange(len(w.start)) + w.row] = w.hashes()
        yield c.lo, c.hi, tokens, np.repeat(np.arange(rows), np.diff(w.first) + 1), np.diff(c.offsets), c.data.tobytes()


def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[Span]:
    """Spans of a task's (doc_id, fold, text) rows, numbered by task and order."""
    task = TaskContext.get()
    base, made = (task.partitionId() if task else 0) << 24, 0
    held: list[tuple] = []
    size = docs = 0

    def close() -> Span:
        return Span(base + made, pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), [h[2] for h in held],
                    np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held]), np.concatenate([h[5] for h in held]))
    for b in batches:
        for lo, hi, tokens, row, lengths, text in token_hashes(b.column(2)):
            held.append((b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo).to_numpy(), text, lengths, tokens, row + docs))
            size += len(text)
            docs += hi - lo
            if size >= SPAN_BYTES:
                yield close()
                held, size, docs, made = [], 0, 0, made + 1
    if held:
        yield close()


def folded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold, F.lit(0)).alias("fold"), F.col(text_col).alias("text"))


def range_count(docs: DataFrame) -> int:
    """Hash ranges, a power of two: about two for each 16 MB of input that a scan task reads."""
    spark = docs.sparkSession
    text = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().rstrip("b")
    size = int(text[:-1]) << {"k": 10, "m": 20, "g": 30}[text[-1]] if text[-1] in "kmg" else int(text)
    each = max(2, size >> 23)
    tasks = docs.select("doc_id").rdd.getNumPartitions()
    return 1 << max(4, min(20, (tasks * min(each, 16) - 1).bit_length()))


def asked(rows: DataFrame, ranges: int) -> DataFrame:
    """(part, span, keys, kept, deleted): what each span asks of each hash range; ranges of pairs follow those of words."""
    shift = U64(64 - ranges.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for span in spans(batches):
            fold = span.fold[span.row]
            deleted = fold == DELETED_FOLD
            kept = (fold != TEST_FOLD) & ~deleted
            for kind, (key, index) in enumerate(span.keys()):
                counts = [np.bincount(index, weights=m, minlength=len(key)).astype(np.uint32) for m in (kept, deleted)]
                cut = np.searchsorted(key >> shift, np.arange(ranges + 1, dtype=U64))
                used = np.flatnonzero(np.diff(cut))
                out = [[squeeze(f(v[cut[p]:cut[p + 1]])) for p in used] for v, f in
                       ((key, lambda k: np.diff(k, prepend=U64(0))), (counts[0], lambda k: k), (counts[1], lambda k: k))]
                yield pa.RecordBatch.from_arrays([pa.array((used + kind * ranges).astype(np.int64)), pa.array(np.full(len(used), span.number)),
                                                  *[pa.array(x, pa.binary()) for x in out]], names=["part", "span", "keys", "kept", "deleted"])
    return rows.mapInArrow(run, "part bigint, span bigint, keys binary, kept binary, deleted binary")


def answered(questions: DataFrame, ranges: int) -> DataFrame:
    """(span, part, kept, deleted) for each question, and per range a row of span -1 with its distinct words and tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in sorted_groups(batches, 1):
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                group = table.slice(lo, hi - lo)
                part = group.column("part")[0].as_py()
                keys = [np.cumsum(expand(x.as_py(), U64), dtype=U64) for x in group.column("keys")]
                ends = np.cumsum([0, *map(len, keys)])
                names, index = np.unique(np.concatenate(keys), return_inverse=True)
                del keys
                total = [np.bincount(index, weights=np.concatenate([expand(x.as_py(), np.uint32) for x in group.column(c)]), minlength=len(names)).astype(U64)
                         for c in ("kept", "deleted")]
                replies = [[squeeze(t[index[a:b]]) for a, b in zip(ends[:-1], ends[1:])] for t in total]
                word = part < ranges
                n, first = len(replies[0]), [[0] * len(replies[0])] * 4
                facts = [int((total[0] + total[1] > 0).sum()), int(total[0].sum() + total[1].sum()), int((total[0] > 0).sum()), int(total[0].sum())] if word else [0] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*group.column("span").to_pylist(), -1], pa.int64()), pa.array([part] * (n + 1), pa.int64()),
                     *[pa.array([*r, b""], pa.binary()) for r in replies], *[pa.array([*z, f], pa.int64()) for z, f in zip(first, facts)]],
                    names=["span", "part", "kept", "deleted", "types", "tokens", "kept_types", "kept_tokens"])
    ordered = questions.repartition("part").sortWithinPartitions("part", "span")
    return ordered.mapInArrow(run, "span bigint, part bigint, kept binary, deleted binary, types bigint, tokens bigint, kept_types bigint, kept_tokens bigint")


def reply_counts(group: pa.Table, ranges: int) -> list[list[np.ndarray]]:
    """[words, pairs] -> [kept, deleted] counts in the order of the span's sorted keys; rows are sorted by part."""
    part = group.column("part").to_numpy()
    out = []
    for lo, hi in ((0, ranges), (ranges, 2 * ranges)):
        rows = group.filter(pa.array((part >= lo) & (part < hi)))
        out.append([np.concatenate([np.zeros(0, U64), *[expand(x.as_py(), U64) for x in rows.column(c)]]) for c in ("kept", "deleted")])
    return out


def contexts(word_count: np.ndarray, word_index: np.ndarray, begins: np.ndarray, start_count: float) -> np.ndarray:
    """Count of the context of every token."""
    count = np.empty(len(word_index))
    count[1:] = word_count[word_index[:-1]]
    count[begins] = start_count
    return count


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole part of its count's logarithm to base 2."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0)


def met(left: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of the spans themselves (part -1) and the answers to them, side by side, sorted by span and part."""
    both = left.unionByName(answers.where("span >= 0").select("span", "part", "kept", "deleted"), allowMissingColumns=True)
    both = both.withColumn("bytes", F.coalesce(F.length("kept"), F.lit(0)).cast("long") + F.coalesce(F.length("z"), F.lit(0)))
    return both.repartition("span").sortWithinPartitions("span", "part")


def span_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for table, bounds in sorted_groups(batches, 1, size="bytes", max_size=1 << 20):
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            yield table.slice(lo, hi - lo)


def check_length(n: int, expected: int) -> None:
    if n != expected:
        raise RuntimeError("the scan gave other spans than before: its input must not change during the run")


def held_out_grid(rows: DataFrame, answers: DataFrame, ranges: int, kept_types: int, kept_tokens: int) -> list:
    """Tokens of the deleted fold by (bucket, quantised pair estimate, quantised word estimate)."""
    def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for span in spans(batches):
            (word, wi), (pair, pi) = span.keys()
            mine = np.flatnonzero(span.fold[span.row] == DELETED_FOLD)
            before = np.concatenate([[-1], wi[:-1]])
            before[span.begins] = -1
            blob = b"".join(struct.pack("<I", len(x)) + x for x in (squeeze(v[mine].astype(np.int32)) for v in (before, wi, pi)))
            end = int(np.searchsorted(word, END))
            yield pa.RecordBatch.from_arrays([pa.array([span.number], pa.int64()), pa.array([-1], pa.int64()), pa.array([blob], pa.binary()),
                                              pa.array([[len(word), len(pair), end]], pa.list_(pa.int64()))], names=["span", "part", "z", "shape"])

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in span_groups(batches):
            blob, parts, at = group.column("z")[0].as_py(), [], 0
            for _ in range(3):
                n = struct.unpack_from("<I", blob, at)[0]
                parts.append(expand(blob[at + 4:at + 4 + n], np.int32))
                at += 4 + n
            before, wi, pi = parts
            n_word, n_pair, end = group.column("shape")[0].as_py()
            (cw, _), (cp, _) = reply_counts(group.slice(1), ranges)
            check_length(len(cw), n_word)
            check_length(len(cp), n_pair)
            context = np.where(before >= 0, cw[before], cw[end] if len(cw) else 0).astype(float)

            def steps(p: np.ndarray) -> np.ndarray:
                return np.where(p > 0, np.round(GRID * np.log2(np.maximum(p, 1e-300))), 1).astype(np.int64)
            key = np.stack([bucket(context), steps(cp[pi] / np.maximum(context, 1)), steps(cw[wi] / max(kept_tokens, 1))])
            cells, count = np.unique(key, axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in cells], pa.array(count)], names=["bucket", "pair", "word", "n"])
    left = rows.mapInArrow(indices, "span bigint, part bigint, z binary, shape array<bigint>")
    cells = met(left, answers).select("span", "part", "z", "shape", "kept", "deleted", "bytes").mapInArrow(grid, "bucket bigint, pair bigint, word bigint, n bigint")
    return cells.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).orderBy("bucket", "pair", "word").collect()


def learn(cells: list, types: int, rounds: int = 100) -> np.ndarray:
    """Weights (pair, word) for each bucket by expectation-maximisation; a bucket without tokens takes its lower neighbour's."""
    weights = np.tile(np.array(DEFAULT), (BUCKETS, 1))
    weights[0] = (0.0, 0.9)
    if not cells:
        return weights
    data = np.array([[r["bucket"], r["pair"], r["word"], r["n"]] for r in cells], float)
    for k in range(BUCKETS):
        mine = data[data[:, 0] == k]
        if not len(mine):
            if k > 1:
                weights[k] = weights[k - 1]
            continue
        p = np.stack([np.where(mine[:, c] <= 0, 2.0 ** (mine[:, c] / GRID), 0.0) for c in (1, 2)] + [np.full(len(mine), 1 / (types + 1))], 1)
        n = mine[:, 3]
        w = np.array([0.0 if k == 0 else 0.4, 0.4, 0.2])
        w /= w.sum()
        for _ in range(rounds):
            share = p * w
            share /= share.sum(1, keepdims=True)
            w = (share * n[:, None]).sum(0) / n.sum()
        w = np.maximum(w, [0.0 if k == 0 else 1e-6, 1e-6, 1e-6])
        weights[k] = (w / w.sum())[:2]
    return weights


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = folded(docs, id_col, text_col)
    ranges = range_count(rows)
    answers = write_layer(answered(asked(rows, ranges), ranges), "lm-answers")
    facts = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "tokens", "kept_types", "kept_tokens")]).first()
    types, tokens = facts["types"], facts["tokens"]
    weights = learn(held_out_grid(rows, answers, ranges, facts["kept_types"], facts["kept_tokens"]), facts["kept_types"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for span in spans(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([span.number], pa.int64()), pa.array([-1], pa.int64()), pa.array([press.compress(b"".join(span.texts))], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(span.ids)], pa.int32()), span.ids),
                 pa.array([span.fold.tolist()], pa.list_(pa.int32())), pa.array([span.lengths.tolist()], pa.list_(pa.int64()))],
                names=["span", "part", "z", "ids", "fold", "lengths"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in span_groups(batches):
            ids = group.column("ids")[0].values
            fold = group.column("fold")[0].values.to_numpy()
            lengths = group.column("lengths")[0].values.to_numpy()
            blob = pa.py_buffer(zstandard.ZstdDecompressor().decompress(group.column("z")[0].as_py()))
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            texts = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), blob])
            held = [(tokens, row + lo) for lo, _, tokens, row, _, _ in token_hashes(texts)]
            span = Span(0, ids, fold, [], lengths, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            (word, wi), (pair, pi) = span.keys()
            cw, cp = [x[0] + x[1] for x in reply_counts(group.slice(1), ranges)]
            check_length(len(cw), len(word))
            check_length(len(cp), len(pair))
            end = cw[np.searchsorted(word, END)]
            context = contexts(cw.astype(float), wi, span.begins, float(end))
            c = cw[wi].astype(float)
            a, b = weights[bucket(context)].T
            p = a * cp[pi] / np.maximum(context, 1) + b * c / max(tokens, 1) + (1 - a - b) / (types + 1)

            def per(v: np.ndarray) -> np.ndarray:
                return np.add.reduceat(v, span.begins)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(fold == TEST_FOLD), pa.array(per(np.ones(len(c), np.int64))), pa.array(per((c > 0).astype(np.int64))),
                 pa.array(np.full(n, tokens)), pa.array(per(np.log10((c + 1) / (tokens + types + 1)))), pa.array(per(np.log10(p)))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    left = rows.mapInArrow(pieces, f"span bigint, part bigint, z binary, ids array<{kind}>, fold array<int>, lengths array<bigint>")
    return (met(left, answers).select("span", "part", "z", "ids", "fold", "lengths", "kept", "deleted", "bytes")
            .mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"))
