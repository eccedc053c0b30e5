"""Small helpers for jobs whose tasks work on sorted groups, and for moving texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(column: pa.Array) -> pa.Array:
    """Each text or blob compressed on its own; null counts as empty."""
    press = zstandard.ZstdCompressor(level=1)
    return pa.array([press.compress(x.as_buffer() if x.is_valid else b"") for x in column.cast(pa.binary())], pa.binary())


def unpack(column: pa.Array) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(x.as_buffer()) for x in column], pa.binary())


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, z): texts compressed before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pack(b.column(1))], names=["doc_id", "z"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, z binary")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text): ``row`` is a digest of id and text, never null, so rows without an id and texts that share one stay apart."""
    name, text = F.col(id_col).cast("string"), F.col(text_col)
    named = F.coalesce(F.concat(F.length(name).cast("string"), F.lit(":"), name), F.lit("-"))
    return docs.select(F.unhex(F.md5(F.concat(named, F.coalesce(F.concat(F.lit("+"), text), F.lit("-"))))).alias("row"),
                       F.col(id_col).alias("doc_id"), text.alias("text"))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 0, size: str | None = None,
                  max_size: int = 1 << 22) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a partition sorted by its first ``keys`` columns, several groups at a time.

    Yields a table and the row at which each group in it begins (with the end). Groups are gathered
    until the values of column ``size`` (lengths in bytes) sum to ``max_size``.
    """
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in range(keys):
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    def gather(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        table = pa.Table.from_batches(held)
        bounds = cut(table)
        whole = len(bounds) - 1 if last else len(bounds) - 2
        weight = np.concatenate([[0], np.cumsum(table.column(size).to_numpy())]) if size else np.arange(table.num_rows + 1)
        g = 0
        while g < whole:
            e = g + 1
            while e < whole and weight[bounds[e + 1]] - weight[bounds[g]] <= max_size:
                e += 1
            yield table.slice(bounds[g], bounds[e] - bounds[g]), bounds[g:e + 1] - bounds[g]
            g = e
        rest = table.slice(bounds[whole]).combine_chunks().to_batches() if not last else []
        held[:] = rest

    pending = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            pending += b.column(b.schema.get_field_index(size)).to_numpy().sum() if size else b.num_rows
            if pending > max_size:
                yield from gather(False)
                pending = 0
    if held:
        yield from gather(True)
