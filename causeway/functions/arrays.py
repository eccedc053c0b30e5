"""Statistics over short arrays held in one row (at most one incident window), and correlation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def mean(a: Column) -> Column:
    """NULL for an empty array."""
    return F.when(F.size(a) > 0, total(a) / F.greatest(F.size(a), F.lit(1)))


def median(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.try_element_at(s, low) + F.try_element_at(s, high)) / 2)


def std(a: Column) -> Column:
    """Population standard deviation."""
    m = mean(a)
    return F.sqrt(mean(F.transform(a, lambda v: (v - m) * (v - m))))


def last(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def pearson(x: Column, y: Column) -> Column:
    """Aggregate correlation of two columns that are NULL together; NULL when either is constant.

    The built-in corr divides by the product of the spreads and fails on a constant side in ANSI mode.
    """
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
