"""Fitted relationship per (incident, component): stationarity, ridge, stability, validity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import kernels as K
from causeway.operators import resampling as D
from causeway.operators import ridge as R
from causeway.operators import stationarity as S
from causeway.operators.lags import GROUP, PAIR
from causeway.session import write_layer


@dataclass
class Fitted:
    """``tests``: unit-root test per series (driver '' is the component); ``fits``: one row per fitted component; ``table``: one row per driver."""

    tests: DataFrame
    fits: DataFrame
    table: DataFrame


def fitted_model(signal: DataFrame, drivers: int) -> Fitted:
    """The model of every component from moments of its history rows. ``drivers``: most drivers of a component."""
    longest = signal.select(F.max(F.size("history_rows")).alias("n")).first()["n"] or 1
    rows = write_layer(S.history(signal), "model-history")
    tests = write_layer(S.unit_roots(rows, S.most_lags(longest)), "model-tests")
    moved = write_layer(S.moved(rows, tests), "model-moved")
    varies = moved.filter("slot = 0").groupBy(*GROUP).agg(((F.count("v") >= K.ADF_MIN_ROWS) & (F.stddev_pop("v") > S.FLAT)).alias("usable"))
    complete = write_layer(R.complete_rows(moved, drivers).join(varies.filter("usable").drop("usable"), GROUP), "model-rows")
    fits = write_layer(R.fits(complete, drivers), "model-fits")
    stable = D.sign_stability(R.standardised(complete.join(fits.select(*GROUP), GROUP), drivers), fits, drivers)
    checks = D.validity(moved, fits, drivers)
    counted = complete.groupBy(*GROUP).agg(F.count("*").alias("n_rows"))
    changed = tests.filter("driver = ''").select(*GROUP, F.col("differenced").alias("component_differenced"))
    fitted = F.col("alpha").isNotNull()
    slot = (F.col("slot") - 1).cast("int")
    table = (tests.filter("driver <> ''").select(*PAIR, "slot", F.col("differenced").alias("driver_differenced"))
             .join(changed, GROUP).join(counted, GROUP, "left").join(fits.drop("n", "p"), GROUP, "left").join(stable, GROUP, "left").join(checks, PAIR, "left"))
    return Fitted(tests, fits, table.select(
        *PAIR, F.when(fitted, "fitted").otherwise("insufficient_history").alias("model_status"),
        F.coalesce(F.get("coef", slot), F.lit(0.0)).alias("historical_coefficient"), "holdout_r2", "p_value",
        F.coalesce("is_significant", F.lit(False)).alias("is_significant"), F.coalesce(F.get("kept", slot), F.lit(0.0)).alias("coefficient_stability"),
        "alpha", F.coalesce("n_rows", F.lit(0)).alias("n_observations"), "validity_method", "driver_differenced", "component_differenced"))
