"""Whole-table helpers."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def given(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows known on the driver, as a local relation: no task starts Python to read them."""
    fields = T.StructType.fromDDL(schema)
    cells = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(cells, fields.names), fields)


def as_text(field: T.StructField) -> Column:
    """A column as text; nested values as JSON, nulls as one NUL character."""
    nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
    value = F.to_json(field.name) if nested else F.col(field.name).cast("string")
    return F.coalesce(value, F.lit("\u0000"))


def total(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))


def print_sums(texts: list[Column]) -> list[Column]:
    """Row count and the sums of both 64-bit halves of every row's md5; prints of two sets of rows add up.

    Usable in ``agg`` and in ``observe``.
    """
    digest = F.md5(F.concat_ws("\u0001", *texts))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10)
    return [F.count(F.lit(1)).alias("row_count"), total(half(1)).alias("high"), total(half(17)).alias("low")]


def content_sum(high: Column, low: Column) -> Column:
    return F.concat_ws(":", high.cast("string"), low.cast("string"))


def fingerprint(df: DataFrame, method: str = "xxhash64") -> DataFrame:
    """Row count and an order-insensitive content sum; duplicates do not cancel out.

    ``md5`` sums both 64-bit halves of the digest of all columns, nested ones included.
    """
    if method == "md5":
        return df.agg(*print_sums([as_text(f) for f in df.schema.fields])).select(
            "row_count", content_sum(F.col("high"), F.col("low")).alias("content_sum"))
    return df.agg(F.count("*").alias("row_count"), total(F.xxhash64(*df.columns)).cast("string").alias("content_sum"))


def observed_print(df: DataFrame, texts: list[Column] | None = None) -> tuple[DataFrame, Observation]:
    """The same rows, with their print taken while they are written.

    Only for a frame that is written as it is: behind a shuffle a repeated task would count twice.
    """
    seen = Observation()
    return df.observe(seen, *print_sums(texts or [as_text(f) for f in df.schema.fields])), seen


def taken(seen: Observation) -> tuple[int, Decimal, Decimal]:
    """(row_count, high, low) after the write; a write whose plan turned out empty observes nothing."""
    got = seen.get
    return got.get("row_count", 0), got.get("high", Decimal(0)), got.get("low", Decimal(0))


def one_row(*parts: DataFrame) -> DataFrame:
    """The columns of several one-row frames as one row, without a join."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows present on one side only, with multiplicity."""
    cols = sorted(left.columns)
    a, b = left.select(*cols), right.select(*cols)
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(
        b.exceptAll(a).withColumn("only_in", F.lit("right")))
