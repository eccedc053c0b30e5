"""Named queries: each takes a workspace and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.plans.workspace import Workspace, workspace

QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {}


def query(fn: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def show(df: DataFrame, ids: str, nums: str = "", digits: int = 6) -> DataFrame:
    """Project to the published columns; ``name:4`` rounds to 4 digits.

    Doubles are rounded with ties going up: the small offset keeps a value that sits on a
    tie from depending on the last bit of a sum. NaN becomes NULL and -0 becomes 0.
    """
    def num(item: str):
        c, _, d = item.partition(":")
        d = int(d or digits)
        x = F.col(c).cast("double")
        return (F.round(F.when(~F.isnan(x), x + F.lit(3.3 * 10.0 ** -(d + 2))), d) + F.lit(0.0)).alias(c)

    def key(c: str):
        kind = df.schema[c].dataType
        if isinstance(kind, (T.IntegerType, T.ShortType)):
            return F.col(c).cast("bigint").alias(c)
        return F.col(c)
    return df.select(*[key(c) for c in ids.split()], *[num(c) for c in nums.split()])


def bound(fn: Callable[[Workspace], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: fn(workspace(spark, path))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from causeway.plans import (  # noqa: F401
        q_contracts, q_evaluate, q_evidence, q_mart, q_model, q_serving, q_stage4, q_stored, q_decision)
    return {name: bound(fn) for name, fn in QUERIES.items()}
