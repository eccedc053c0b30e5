"""Lag search on history only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.functions.arrays import pearson
from causeway.operators.mart import week_of
from causeway.operators.series import INCIDENT

PAIR = INCIDENT + ["component", "driver"]
GROUP = INCIDENT + ["component"]

# Overlap and tie rules.
MIN_OVERLAP = 15
MIN_COARSE_PERIODS = 6
TIE = 0.02


def cluster(pairs: DataFrame) -> DataFrame:
    """One shuffle by (incident, component) serves the period means, the lags, the profiles and the model."""
    return pairs.repartition(*GROUP)


def period_means(pairs: DataFrame) -> DataFrame:
    """Driver and component per source period: the day itself, the week, or n-day buckets."""
    origin = F.min("metric_date").over(W.partitionBy(*PAIR))
    period = (
        F.when(F.col("cadence") == 1, F.unix_date("metric_date"))
        .when(F.col("cadence") == 7, F.unix_date(week_of("metric_date")))
        .otherwise(F.floor(F.datediff("metric_date", origin) / F.col("cadence")).cast("int"))
    )
    return (
        pairs.filter("role = 'history'").withColumn("period", period)
        .groupBy(*PAIR, "period", "cadence", "steps").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    )


def lag_correlations(periods: DataFrame, most_steps: int) -> DataFrame:
    """Pearson correlation of driver(t - k) with component(t) for every admissible k.

    NULL where the overlap is too short or either side is constant.
    """
    order = W.partitionBy(*PAIR).orderBy("period")
    shifted = F.array(*[F.struct(F.lit(k).alias("k"), F.lag("x", k).over(order).alias("x"))
                        for k in range(most_steps + 1)])
    rows = (
        periods.withColumn("s", shifted).select(*PAIR, "cadence", "steps", "y", F.explode("s").alias("s"))
        .select(*PAIR, "cadence", "steps", "s.k", "s.x", "y").filter("k <= steps")
    )
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y = F.when(both, F.col("x")), F.when(both, F.col("y"))
    needed = F.when(F.col("cadence") == 1, MIN_OVERLAP).otherwise(
        F.greatest(F.lit(MIN_COARSE_PERIODS), F.ceil(F.lit(MIN_OVERLAP) / F.col("cadence"))))
    return (
        rows.groupBy(*PAIR, "k", "cadence").agg(
            F.count(x).alias("overlap"), pearson(x, y).alias("r"),
            F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
        .select(*PAIR, "k", (F.col("k") * F.col("cadence")).alias("lag_days"), "overlap",
                F.when((F.col("overlap") >= needed) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
                       & ~F.isnan("r"), F.col("r")).alias("correlation"))
    )


def better(acc: Column, e: Column) -> Column:
    wins = e["correlation"].isNotNull() & (F.abs(e["correlation"]) > acc["best"] + TIE)
    take = F.struct(F.abs(e["correlation"]).alias("best"), e["correlation"].alias("correlation"),
                    e["lag_days"].alias("lag_days"), e["overlap"].alias("overlap"))
    return F.when(wins, take).otherwise(acc)


def best_lags(correlations: DataFrame) -> DataFrame:
    """Shortest convincing lag: a longer one must raise |r| by more than the tie tolerance.

    The rule depends on the order of the lags, so it is a fold and not an arg-max.
    """
    cells = F.sort_array(F.collect_list(F.struct("k", "correlation", "lag_days", "overlap")))
    start = F.struct(F.lit(-1.0).alias("best"), F.lit(0.0).alias("correlation"), F.lit(0).alias("lag_days"),
                     F.lit(0).cast("bigint").alias("overlap"))
    return (
        correlations.groupBy(*PAIR).agg(cells.alias("cells"))
        .withColumn("b", F.aggregate("cells", start, better))
        .select(*PAIR, F.col("b.lag_days").alias("best_lag_days"),
                F.col("b.correlation").alias("historical_lag_correlation"), F.col("b.overlap").alias("overlap"))
    )
