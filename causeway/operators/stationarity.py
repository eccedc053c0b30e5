"""Unit-root test of every series of an incident from cross-moments of its lags.

All lag orders share one moment matrix on a common range of rows: eliminating its columns in turn
gives the residual of each order, and Akaike's criterion chooses one. The chosen order is fitted again
on all of its own rows, with the level last, so that its t-statistic can be read off.
"""

from __future__ import annotations

import math
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.functions import kernels as K
from causeway.functions.linear import critical_statistic, cross_moments, lag_order, level_statistic
from causeway.operators.lags import GROUP, PAIR
from causeway.session import write_layer

FLAT = 1e-8


def history(signal: DataFrame) -> DataFrame:
    """(incident, component, driver, slot, i, v): history rows of each driver, and of the component itself as driver '' in slot 0.

    ``slot`` numbers a component's drivers from 1 in contract order; values that are no number are NULL.
    """
    ranked = signal.withColumn("slot", F.row_number().over(W.partitionBy(*GROUP).orderBy("ordinal", "driver")))
    rows = ranked.select(*PAIR, "slot", "best_lag_days", F.posexplode("history_rows").alias("i", "r"))
    number = lambda c: F.when(~F.isnan(c), c)
    drivers = rows.select(*PAIR, "slot", F.col("best_lag_days").cast("int").alias("lag"), "i", number(F.col("r.x").cast("double")).alias("v"))
    component = rows.filter("slot = 1").select(*GROUP, F.lit("").alias("driver"), F.lit(0).alias("slot"), F.lit(0).alias("lag"), "i",
                                               number(F.col("r.y").cast("double")).alias("v"))
    return drivers.unionByName(component)


def most_lags(n: int) -> int:
    return int(math.ceil(12.0 * (n / 100.0) ** 0.25))


def unit_roots(rows: DataFrame, most: int) -> DataFrame:
    """(incident, component, driver, n, lag_order, statistic, degenerate, differenced) of each series; ``most``: largest lag order that occurs.

    Too short, flat or infinite series are degenerate and become zeros. A design whose columns depend on
    each other has no statistic, and the series is differenced.
    """
    whole = W.partitionBy(*PAIR)
    seen = rows.filter("v IS NOT NULL").withColumns({"n": F.count("*").over(whole), "mean": F.avg("v").over(whole), "sd": F.stddev_pop("v").over(whole),
                                                     "top": F.max(F.abs("v")).over(whole)})
    bad = (F.col("n") < K.ADF_MIN_ROWS) | (F.col("top") == float("inf")) | F.isnan("sd") | (F.col("sd") <= FLAT)
    order = whole.orderBy("i")
    lags = F.least(F.ceil(12.0 * F.pow(F.col("n") / 100.0, F.lit(0.25))), F.floor(F.col("n") / 2) - 2).cast("int")
    # statistic and criterion do not change with the scale of the series
    z = (F.col("v") - F.col("mean")) / F.col("sd")
    steps = (seen.filter(~bad).withColumns({"z": z, "t": F.row_number().over(order), "lags": lags}).withColumn("before", F.lag("z", 1).over(order))
             .withColumn("d", F.col("z") - F.col("before")).withColumns({f"d{k}": F.lag("d", k).over(order) for k in range(1, most + 1)}))

    # read twice: for the choice of the order, and for the fit of the chosen one
    steps = write_layer(steps.drop("v", "mean", "sd", "top", "z"), "model-steps")

    def regressors(order_col: str) -> list:
        return [F.when(F.lit(k) <= F.col(order_col), F.col(f"d{k}")).otherwise(0.0) for k in range(1, most + 1)]
    one = F.lit(1.0)
    common = steps.filter("t >= lags + 2").groupBy(*PAIR, "lags").agg(
        cross_moments([one, F.col("before"), *regressors("lags"), F.col("d")]).alias("m"), F.count("*").alias("m_rows"))
    picked = common.select(*PAIR, lag_order("m", "m_rows", "lags").alias("lag_order")).filter("lag_order IS NOT NULL")
    own = (steps.join(picked, PAIR).filter("t >= lag_order + 2").groupBy(*PAIR, "lag_order")
           .agg(cross_moments([one, *regressors("lag_order"), F.col("before"), F.col("d")]).alias("m"), F.count("*").alias("m_rows")))
    tested = own.select(*PAIR, "lag_order", level_statistic("m", "m_rows", "lag_order").alias("statistic"))
    sizes = seen.groupBy(*PAIR).agg(F.first("n").alias("n"), F.first(bad).alias("degenerate"))
    every = rows.select(*PAIR, "slot", "lag").distinct().join(sizes, PAIR, "left").join(tested, PAIR, "left")
    degenerate = F.coalesce("degenerate", F.lit(True))
    return every.select(*PAIR, "slot", "lag", F.coalesce("n", F.lit(0)).alias("n"), "lag_order", "statistic", degenerate.alias("degenerate"),
                        (degenerate | F.coalesce(F.col("statistic") > critical_statistic(), F.lit(True))).alias("differenced"))


def moved(rows: DataFrame, tests: DataFrame) -> DataFrame:
    """(incident, component, driver, slot, i, v): every series itself, its first difference, or zeros, moved down by its lag.

    A lag counts rows that the series has: all of its own, or those that have a difference.
    """
    order = W.partitionBy(*PAIR).orderBy("i")
    df = rows.join(tests.select(*PAIR, "degenerate", "differenced"), PAIR).withColumn("step", F.col("v") - F.lag("v", 1).over(order))
    value = F.when(F.col("degenerate"), 0.0).when(F.col("differenced"), F.col("step")).otherwise(F.col("v"))
    df = df.withColumn("now", value).filter("NOT differenced OR degenerate OR now IS NOT NULL").withColumn("rn", F.row_number().over(order))
    there = df.select(*PAIR, "slot", "i", "rn")
    here = df.select(*PAIR, (F.col("rn") + F.col("lag")).alias("rn"), F.when(F.abs("now") < float("inf"), F.col("now")).alias("v"))
    return there.join(here, [*PAIR, "rn"], "left").select(*PAIR, "slot", "i", "v")
