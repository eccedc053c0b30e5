"""Phrase collocations from sorted count streams.

1. Counting, level by level. Texts (A-Z lowered) are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at
   space and tab into words. The grams of each length are counted within chunks of text and then over the
   corpus, per language. From the second level on only grams whose two parts of one word fewer are frequent
   go on, as no other can be. Frequent grams of a level meet the next pass as a bitmap of their hashes, of
   bounded size (``MAX_BITS``): a false hit costs a row, never a count; counts are kept by the gram's own text.
2. Two streams of the frequent grams are sorted: in prefix order (words first to last) and in suffix order
   (last to first), each range-partitioned. In prefix order a gram follows its own prefixes, so one lockstep
   pass with a stack of at most four gives the counts of all left parts and the largest extension to the
   right; suffix order gives right parts and left extensions. Only the prefixes of a partition's first gram
   can lie in an earlier partition: these few (three a partition) are carried over by a small join.
3. The two streams are merge-joined by gram: scores, subsumed phrases, and each language's first phrases.

A phrase that a longer one of two more words subsumes is subsumed by one of one more word too, which is a
gram at least as frequent; so extensions by one word are all that is needed.

Null texts are empty, and a null language is ``und``. Repeated rows and ids count as often as they occur.
Languages without a phrase give no row, and an empty table an empty result. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from causeway.llm.spaced import respaced, texts_at
from causeway.llm.tokens import U64, Words, chunks, grams, mix, words
from causeway.session import write_layer

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
SUBSUMED_PERCENT = 80
SCALE = 2_000_000
COUNT_BYTES = 1 << 21
#: The bitmap has 64 bits for each frequent gram and at most so many in all (32 MB).
MAX_BITS = 28
#: Ends of pieces: sentence marks and line ends.
BREAK = np.zeros(256, bool)
BREAK[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
WORD = ~BREAK
WORD[[0x20, 0x09]] = False


def salts(langs: pa.Array) -> np.ndarray:
    """A fixed hash of each row's language."""
    coded = langs.dictionary_encode()
    table = np.array([zlib.crc32(x.encode()) for x in coded.dictionary.to_pylist()], U64)
    return mix(table + U64(1))[coded.indices.to_numpy()] if len(table) else np.zeros(0, U64)


def piece_ends(w: Words) -> np.ndarray:
    """For each word the last word of its piece."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    marks = np.concatenate([[0], np.cumsum(BREAK[w.data])])
    last = np.ones(len(w.start), bool)
    last[:-1] = (marks[w.start[1:]] > marks[w.end[:-1]]) | (np.diff(w.row) > 0)
    ends = np.flatnonzero(last)
    return np.repeat(ends, np.diff(ends, prepend=-1))


class Bitmap:
    """A set of hashes by their leading bits, as one bit each."""

    def __init__(self, bits: int, slot: np.ndarray, value: np.ndarray) -> None:
        self.shift = U64(64 - bits)
        self.bits = np.zeros(1 << (bits - 6), U64)
        self.bits[slot] = value.view(U64)


    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool)


def counts(docs: DataFrame, k: int, smaller: Bitmap | None, lang_col: str, text_col: str) -> DataFrame:
    """(lang, gram, n): occurrences of each gram of k words; for k = 1 also (lang, null, all words)."""
    shared = docs.sparkSession.sparkContext.broadcast(smaller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smaller = shared.value
        for b in batches:
            for c in chunks(b.column(1), COUNT_BYTES):
                langs = b.column(0).slice(c.lo, c.hi - c.lo)
                w = words(c, WORD, lower=True)
                salt, row, h = salts(langs), w.row, w.hashes()
                if k == 1:
                    size = np.diff(w.first)
                    yield pa.RecordBatch.from_arrays([langs.filter(pa.array(size > 0)), pa.nulls(int((size > 0).sum()), pa.binary()), pa.array(size[size > 0])], names=["lang", "gram", "n"])
                ok = np.arange(len(h)) + k - 1 <= piece_ends(w)
                if k > 1:
                    part = grams(h, k - 1)
                    seen = smaller.has(mix(part ^ salt[row[:len(part)]]))
                    ok = ok[:max(0, len(seen) - 1)] & seen[:-1] & seen[1:]
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                _, index, n = np.unique(mix(grams(h, k)[at] ^ salt[row[at]]), return_index=True, return_counts=True)
                at = at[index]
                data, start, end = respaced(w, WORD)
                offsets, body = texts_at(data, start[at], end[at + k - 1])
                names = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(row[at])), names, pa.array(n)], names=["lang", "gram", "n"])
    found = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, gram binary, n bigint")
    return found.groupBy("lang", F.col("gram").cast("string").alias("gram")).agg(F.sum("n").alias("n"))


def bitmap(frequent: DataFrame, size: int, max_bits: int = MAX_BITS) -> Bitmap:
    """The hashes of ``frequent`` (lang, gram) in at most 2 ** max_bits bits; the driver gets at most as many."""
    bits = min(max_bits, max(12, (64 * size).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                w = words(c, WORD)
                h, k = w.hashes(), np.diff(w.first)
                salt, out = salts(b.column(0).slice(c.lo, c.hi - c.lo)), []
                for n in np.unique(k):
                    mine = np.flatnonzero(k == n)
                    out.append(mix(grams(h, int(n))[w.first[mine]] ^ salt[mine]))
                at = np.concatenate(out) >> U64(64 - bits)
                yield pa.RecordBatch.from_arrays([pa.array((at >> U64(6)).astype(np.int64)), pa.array((U64(1) << (at & U64(63))).view(np.int64))], names=["slot", "value"])
    rows = frequent.select("lang", "gram").mapInArrow(run, "slot bigint, value bigint").groupBy("slot").agg(F.bit_or("value").alias("value")).toArrow()
    return Bitmap(bits, rows.column("slot").to_numpy(), rows.column("value").to_numpy())


def frequent_grams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, min_count: int = MIN_COUNT,
                   max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, gram, words, f) of all grams with f >= ``min_count``, (lang, n) of all words)."""
    total, levels, smaller = None, [], None
    for k in range(1, longest + 1):
        found = counts(docs, k, smaller, lang_col, text_col)
        level = write_layer(found.where(F.col("gram").isNull() | (F.col("n") >= min_count)), f"phrases-{k}")
        if k == 1:
            total = level.where("gram IS NULL").select("lang", "n")
            level = level.where("gram IS NOT NULL")
        levels.append(level.select("lang", "gram", F.lit(k).alias("words"), F.col("n").alias("f")))
        size = level.count()
        if k == longest or not size:
            break
        smaller = bitmap(level, size, max_bits)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, total


def lockstep(stream: DataFrame, partitions: int | None = None) -> DataFrame:
    """(lang, path, f, parts, widest): for each gram of a stream (lang, path, f), in the order of ``path`` (its words), the
    counts of its prefixes of 1, 2, ... words and the largest count of a gram that has one word more at the end.

    ``parts`` and ``widest`` are null where there is none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("path", pa.list_(pa.string())), ("f", pa.int64()), ("parts", pa.list_(pa.int64())), ("widest", pa.int64())])
        held: list[list] = []      # the gram before and its prefixes: [path, f or None, parts, widest]
        now, out = None, []
        for b in batches:
            for lang, path, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if lang != now:
                    out += [(now, *entry) for entry in held]
                    held, now = [], lang
                while held and held[-1][0] != path[:len(held[-1][0])]:
                    out.append((now, *held.pop()))
                for k in range(len(held) + 1, len(path)):  # prefixes that lie in an earlier partition
                    held.append([path[:k], None, [e[1] for e in held], None])
                if held and len(path) > 1:
                    held[-1][3] = max(f, held[-1][3] or 0)
                held.append([path, f, [e[1] for e in held], None])
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema)
                out = []
        out += [(now, *entry) for entry in held]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema)
    ranged = stream.select("lang", "path", "f")
    ranged = (ranged.repartitionByRange(partitions, "lang", "path") if partitions else ranged.repartitionByRange("lang", "path")).sortWithinPartitions("lang", "path")
    passed = write_layer(ranged.mapInArrow(run, "lang string, path array<string>, f bigint, parts array<bigint>, widest bigint"), "phrases-pass")
    whole = passed.where("f IS NOT NULL")
    # at most three prefixes for each partition: grams of earlier partitions, with what this one says of them
    open_ = passed.where("f IS NULL").groupBy("lang", "path").agg(F.max("widest").alias("more"))
    carried = whole.select("lang", "path", F.col("f").alias("known")).join(F.broadcast(open_), ["lang", "path"])
    carried = write_layer(carried, "phrases-carried")
    small = F.broadcast(carried.select("lang", F.col("path").alias("at"), "known", "more"))
    for k in range(1, LONGEST):
        part = small.toDF("at_lang", "at_path", f"known_{k}", "_more").drop("_more")
        whole = (whole.join(F.broadcast(part), (F.col("lang") == F.col("at_lang")) & (F.slice("path", 1, k) == F.col("at_path")) & (F.size("path") > k), "left").drop("at_lang", "at_path"))
    own = small.toDF("at_lang", "at_path", "_known", "more").drop("_known")
    whole = whole.join(F.broadcast(own), (F.col("lang") == F.col("at_lang")) & (F.col("path") == F.col("at_path")), "left")
    parts = F.array(*[F.coalesce(F.get("parts", F.lit(k - 1)), F.col(f"known_{k}")) for k in range(1, LONGEST)])
    return whole.select("lang", "path", "f", parts.alias("parts"), F.greatest("widest", "more").alias("widest"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP,
                 subsumed_percent: int = SUBSUMED_PERCENT, scale: int = SCALE, partitions: int | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """Each language's first ``top`` phrases: (lang, rank, phrase, a, l, r, n, score)."""
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    found, total = frequent_grams(docs, lang_col, text_col, longest, min_count, max_bits)
    stream = found.select("lang", F.split("gram", " ").alias("path"), "f")
    forward = lockstep(stream, partitions).select("lang", F.array_join("path", " ").alias("phrase"), F.size("path").alias("words"), F.col("f").alias("a"),
                                                  F.col("parts").alias("left"), F.col("widest").alias("wider_right"))
    backward = lockstep(stream.withColumn("path", F.reverse("path")), partitions).select(
        "lang", F.array_join(F.reverse("path"), " ").alias("phrase"), F.col("parts").alias("right"), F.col("widest").alias("wider_left"))
    both = forward.where("words > 1").join(backward.hint("merge"), ["lang", "phrase"])
    wide = "decimal(38,0)"

    def cut(k: int) -> Column:
        left, right = F.get("left", F.lit(k - 1)), F.get("right", F.col("words") - F.lit(k + 1))
        score = F.call_function("div", F.lit(scale).cast("decimal(10,0)") * F.col("a").cast("decimal(20,0)"), left.cast("decimal(20,0)") + right.cast("decimal(20,0)"))
        return F.when(F.col("words") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    wider = F.greatest(F.coalesce("wider_left", F.lit(0)), F.coalesce("wider_right", F.lit(0)))
    kept = both.where(~(F.lit(100).cast(wide) * wider >= F.lit(subsumed_percent).cast(wide) * F.col("a")))
    scored = kept.select("lang", "phrase", "a", F.least(*[cut(k) for k in range(1, LONGEST)]).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's phrases are cut to the first of each of 64 parts before they meet
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = scored.withColumn("_part", part).withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
