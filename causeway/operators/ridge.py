"""Ridge regression per (incident, component) from moments of contiguous folds.

One aggregation gives the cross-moments of each fold. The moments a fold is trained on are the total
less its own, and both its fit and its error are read off the two matrices, for all penalties at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.functions import kernels as K
from causeway.functions.linear import EQUAL, added, coefficients, cross_moments, fit_score, minus, penalty_scores
from causeway.operators.evidence import required_rows
from causeway.operators.lags import GROUP


def complete_rows(moved: DataFrame, drivers: int) -> DataFrame:
    """(incident, component, n, p, idx, y, x1, ...): rows on which the component and all of its drivers have a value, in order.

    ``drivers``: most drivers of a component; columns beyond a component's own are zero.
    """
    p = F.max("slot").over(W.partitionBy(*GROUP))
    wide = (moved.withColumn("p", p).groupBy(*GROUP, "p", "i").agg(
        F.count("v").alias("present"), F.max(F.when(F.col("slot") == 0, F.col("v"))).alias("y"),
        *[F.coalesce(F.max(F.when(F.col("slot") == k, F.col("v"))), F.lit(0.0)).alias(f"x{k}") for k in range(1, drivers + 1)])
        .filter("present = p + 1"))
    group = W.partitionBy(*GROUP)
    return wide.withColumns({"n": F.count("*").over(group), "idx": F.row_number().over(group.orderBy("i")) - 1}).drop("present")


def standardised(rows: DataFrame, drivers: int) -> DataFrame:
    """Every column less its mean, over its spread; ``sd_y`` keeps the target's."""
    group = W.partitionBy(*GROUP)
    names = ["y", *[f"x{k}" for k in range(1, drivers + 1)]]
    sd = {f"sd_{c}": F.stddev_pop(c).over(group) for c in names}
    df = rows.withColumns({**{f"m_{c}": F.avg(c).over(group) for c in names}, **sd})
    spread = lambda c: F.when(F.col(f"sd_{c}") < 10 * 2.220446049250313e-16, 1.0).otherwise(F.col(f"sd_{c}"))
    return df.select(*GROUP, "n", "p", "idx", spread("y").alias("sd_y"), *[((F.col(c) - F.col(f"m_{c}")) / spread(c)).alias(c) for c in names])


def fold(idx: Column, n: Column, k: Column) -> Column:
    """Contiguous folds whose sizes differ by one at most, the larger ones first."""
    size, more = F.floor(n / k), n % k
    wide = more * (size + 1)
    return F.when(idx < wide, F.floor(idx / (size + 1))).otherwise(more + F.floor((idx - wide) / size)).cast("int")


def best_penalty(folds: DataFrame, drivers: int) -> DataFrame:
    """(incident, component, alpha) of the best mean R2. ``folds``: (incident, component, m) for each fold."""
    total = folds.groupBy(*GROUP).agg(added("m", drivers + 2).alias("total"))
    trained = folds.join(total, GROUP).select(*GROUP, "m", minus("total", "m").alias("train"))
    scored = trained.select(*GROUP, F.posexplode(penalty_scores("m", "train")).alias("k", "score")).groupBy(*GROUP, "k").agg(F.avg("score").alias("score"))
    near = scored.withColumn("top", F.max("score").over(W.partitionBy(*GROUP))).filter(F.col("score") >= F.col("top") - EQUAL)
    return near.groupBy(*GROUP).agg(F.element_at(F.array(*[F.lit(float(a)) for a in K.ALPHAS]), F.min("k") + 1).alias("alpha"))


def fits(rows: DataFrame, drivers: int) -> DataFrame:
    """(incident, component, n, p, alpha, coef, holdout_r2) of the components with enough complete rows. ``rows``: ``complete_rows``."""
    z = standardised(rows.filter(F.col("n") >= required_rows(F.col("p"))), drivers)
    features = [F.lit(1.0), *[F.col(f"x{k}") for k in range(1, drivers + 1)], F.col("y")]
    n, cut = F.col("n"), F.floor(F.col("n") * 0.8).cast("int")
    outer = F.least(F.lit(5), F.greatest(F.lit(2), F.floor(n / F.greatest(F.lit(10), 5 * F.col("p"))))).cast("int")
    inner = F.greatest(F.lit(2), F.least(F.lit(5), F.floor(cut / 10))).cast("int")
    held = (cut >= 10) & (n - cut >= 5)
    placed = z.withColumns({"outer": fold(F.col("idx"), n, outer),
                            "inner": F.when(held, F.when(F.col("idx") < cut, fold(F.col("idx"), cut, inner)).otherwise(-1))})
    cells = placed.groupBy(*GROUP, "n", "p", "sd_y", "outer", "inner").agg(cross_moments(features).alias("m"))
    size = drivers + 2
    by_outer = cells.groupBy(*GROUP, "outer").agg(added("m", size).alias("m"))
    by_inner = cells.filter("inner IS NOT NULL").groupBy(*GROUP, "inner").agg(added("m", size).alias("m"))
    total = cells.groupBy(*GROUP, "n", "p", "sd_y").agg(added("m", size).alias("m"))
    fitted = total.join(best_penalty(by_outer, drivers), GROUP).withColumn("coef", coefficients("m", "alpha"))
    train = by_inner.filter("inner >= 0").groupBy(*GROUP).agg(added("m", size).alias("train"))
    held_out = (train.join(by_inner.filter("inner = -1").select(*GROUP, "m"), GROUP).join(best_penalty(by_inner.filter("inner >= 0"), drivers), GROUP)
                .select(*GROUP, fit_score("m", "train", "alpha").alias("holdout_r2")))
    return fitted.join(held_out, GROUP, "left").select(*GROUP, "n", "p", "alpha", F.transform("coef", lambda c: c * F.col("sd_y")).alias("coef"), "holdout_r2")
