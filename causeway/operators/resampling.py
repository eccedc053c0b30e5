"""Resampling by counter-based draws.

Draw number s of replicate r of a group is a hash of (group, purpose, r, s) modulo the group's rows. The
replicates are a relation like any other: no generator's state, and a repeated task draws the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.functions import kernels as K
from causeway.functions.arrays import pearson
from causeway.functions.linear import coefficients, cross_moments
from causeway.operators.lags import GROUP, PAIR

#: A hash gives this many draws of 8 hexadecimal digits each.
PER_HASH = 4
#: A standardised coefficient this small is zero: the driver is constant on the drawn rows.
NO_EFFECT = 1e-9


def draws(keys: list[str], purpose: str, replicate: str, block: str, n: Column) -> Column:
    """Row numbers of the draws 4 * block to 4 * block + 3."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(purpose), F.col(replicate).cast("string"), F.col(block).cast("string")))
    return F.array(*[F.conv(F.substring(digest, 8 * j + 1, 8), 16, 10).cast("bigint") % n for j in range(PER_HASH)])


def slots(df: DataFrame, keys: list[str], purpose: str, replicates: int, size: Column, n: Column) -> DataFrame:
    """``df`` once for each draw: adds ``replicate`` and ``drawn``, the row number."""
    many = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    many = many.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / PER_HASH).cast("int"))))
    many = many.withColumn("some", draws(keys, purpose, "replicate", "block", n))
    return many.select("*", F.posexplode("some").alias("at", "drawn")).filter(F.col("block") * PER_HASH + F.col("at") < size).drop("some", "block", "at")


def sign_stability(z: DataFrame, fits: DataFrame, drivers: int) -> DataFrame:
    """(incident, component, kept): for each driver the share of refits on drawn rows that keep its coefficient's sign.

    ``z``: standardised complete rows; a replicate whose target is constant keeps no sign.
    """
    size = F.least(F.greatest(F.floor(F.col("n") * K.RESAMPLE_SHARE).cast("int"), F.lit(K.MIN_ROWS)), F.col("n"))
    drawn = slots(fits.select(*GROUP, "n"), GROUP, "stability", K.RESAMPLES, size, F.col("n"))
    rows = drawn.select(*GROUP, "replicate", F.col("drawn").alias("idx")).join(z.drop("n"), [*GROUP, "idx"])
    features = [F.lit(1.0), *[F.col(f"x{k}") for k in range(1, drivers + 1)], F.col("y")]
    refits = rows.groupBy(*GROUP, "replicate").agg(cross_moments(features).alias("m"), (F.max("y") > F.min("y")).alias("varies"))
    refits = refits.join(fits.select(*GROUP, "alpha", "coef"), GROUP).withColumn("again", coefficients("m", "alpha"))
    def sign(k: int) -> Column:
        again = F.get("again", F.lit(k))
        return F.when(F.abs(again) <= NO_EFFECT, 0.0).otherwise(F.signum(again))
    same = [F.sum(F.when(F.col("varies") & (sign(k) == F.signum(F.get("coef", F.lit(k)))), 1).otherwise(0)) / K.RESAMPLES for k in range(drivers)]
    return refits.groupBy(*GROUP).agg(F.array(*same).alias("kept"))


def student_p(t: Column, freedom: Column) -> Column:
    """Two-sided p-value for whole degrees of freedom, by the finite series in the angle atan(t / sqrt(freedom))."""
    angle = F.atan2(F.abs(t), F.sqrt(freedom))
    cosine, sine = F.cos(angle), F.sin(angle)
    odd = freedom % 2 == 1
    start = F.struct(F.when(odd, cosine).otherwise(F.lit(1.0)).alias("term"), F.lit(0.0).alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        ratio = F.when(odd, (2 * j) / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
        return F.struct((acc["term"] * ratio * cosine * cosine).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))
    steps = F.when(odd, (freedom - 1) / 2).otherwise(freedom / 2).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, step)["sum"]
    inside = F.when(odd, 2 / math.pi * (angle + F.when(freedom > 1, sine * total).otherwise(0.0))).otherwise(sine * total)
    return F.greatest(F.lit(0.0), 1 - inside)


def pair_moments(moved: DataFrame) -> DataFrame:
    """(pair, slot, n, m, flat, xs, ys): moments of (1, x, y) of each driver with its component where both have a value, and their standardised values in order."""
    y = moved.filter("slot = 0").select(*GROUP, "i", F.col("v").alias("y"))
    both = moved.filter("slot > 0 AND v IS NOT NULL").withColumnRenamed("v", "x").join(y.filter("y IS NOT NULL"), [*GROUP, "i"])
    whole = W.partitionBy(*PAIR)
    scaled = lambda c: F.coalesce((F.col(c) - F.avg(c).over(whole)) / F.nullif(F.stddev_pop(c).over(whole), F.lit(0.0)), F.lit(0.0))
    both = both.withColumns({"zx": scaled("x"), "zy": scaled("y")})
    cells = F.sort_array(F.collect_list(F.struct("i", "zx", "zy")))
    return both.groupBy(*PAIR, "slot").agg(F.count("*").cast("int").alias("n"), cross_moments([F.lit(1.0), F.col("x")]).alias("m"), pearson(F.col("zx"), F.col("zy")).alias("r"),
                                           (F.max("x") <= F.min("x")).alias("flat"), cells.alias("rows")) \
        .withColumns({"xs": F.transform("rows", lambda e: e["zx"]), "ys": F.transform("rows", lambda e: e["zy"])}).drop("rows")


def interval_significant(pairs: DataFrame, candidates: int) -> DataFrame:
    """(pair, beyond): whether the percentile interval of the drawn correlations, widened for the candidates, excludes zero. ``pairs``: with p."""
    # a pair makes half a thousand replicates: many tasks, however few bytes there are before
    spread = pairs.select(*PAIR, "n", "p", "xs", "ys").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PAIR)
    drawn = slots(spread, PAIR, "interval", K.DRAWS, F.col("n"), F.col("n"))
    x, y = F.get("xs", F.col("drawn").cast("int")), F.get("ys", F.col("drawn").cast("int"))
    rows = drawn.select(*PAIR, "n", "p", "replicate", x.alias("x"), y.alias("y"))
    sums = rows.groupBy(*PAIR, "n", "p", "replicate").agg(*[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xy", "yy")], F.sum("x").alias("x"), F.sum("y").alias("y"))
    n = F.col("n")
    sx, sy = n * F.col("xx") - F.col("x") * F.col("x"), n * F.col("yy") - F.col("y") * F.col("y")
    r = F.when((sx > 1e-9) & (sy > 1e-9), (n * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(sx * sy))
    tails = [K.SIGNIFICANCE / k / 2 for k in range(1, candidates + 1)]
    ends = sums.withColumn("r", r).groupBy(*PAIR, "p").agg(F.count("r").alias("valid"), F.percentile("r", F.array(*[F.lit(t) for t in tails])).alias("low"),
                                                         F.percentile("r", F.array(*[F.lit(1 - t) for t in tails])).alias("high"))
    k = (F.col("p") - 1).cast("int")
    return ends.select(*PAIR, F.coalesce((F.col("valid") >= 30) & ((F.get("low", k) > 0) | (F.get("high", k) < 0)), F.lit(False)).alias("beyond"))


def validity(moved: DataFrame, sizes: DataFrame, candidates: int) -> DataFrame:
    """(pair, validity_method, p_value, is_significant). ``sizes``: (incident, component, p) of the fitted components."""
    pairs = pair_moments(moved).join(sizes.select(*GROUP, F.col("p").cast("int").alias("p")), GROUP)
    n = F.col("n")
    one, x, xx = (F.get("m", F.lit(k)) for k in (0, 1, 2))
    half, det = (one + xx) / 2, one * xx - x * x
    root = F.sqrt(F.greatest(half * half - det, F.lit(0.0)))
    # the smaller root by way of the product, without cancellation
    condition = F.when(det > 0, (half + root) / F.sqrt(det)).otherwise(float("inf"))
    line = (n >= K.MIN_ROWS) & ~F.col("flat") & (condition <= K.MAX_CONDITION)
    r = F.coalesce("r", F.lit(0.0))
    t = F.when(r * r < 1, r * F.sqrt((n - 2) / (1 - r * r)))
    p = F.least(F.lit(1.0), F.when(t.isNull(), 0.0).otherwise(student_p(F.coalesce(t, F.lit(0.0)), n - 2)) * F.greatest(F.col("p"), F.lit(1)))
    method = F.when(line, "ols").when(n >= K.MIN_OVERLAP, "bootstrap").otherwise("none")
    graded = pairs.withColumns({"validity_method": method, "p_value": F.when(line, p)})
    beyond = interval_significant(graded.filter("validity_method = 'bootstrap'"), candidates)
    return graded.join(beyond, PAIR, "left").select(*PAIR, "validity_method", "p_value",
                                                    F.when(line, F.col("p_value") < K.SIGNIFICANCE).otherwise(F.coalesce("beyond", F.lit(False))).alias("is_significant"))
