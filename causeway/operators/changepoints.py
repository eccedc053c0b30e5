"""Changepoint detection per (kpi, region)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import kernels
from causeway.operators.mart import history_sufficiency
from causeway.operators.series import GAP_BUFFER
from causeway.sources.contracts import Contract

SCHEMA = ("kpi string, region string, changepoint_date date, segment_mean_before double, "
          "segment_mean_after double, shift_magnitude double, method string")
NAMES = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
METHOD = "pelt_l2"


def _detect(unit: str, jump: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("metric_date")
        place = rows["day"].to_numpy() if unit == "days" else np.arange(len(rows))
        found = kernels.changepoints(rows["value"].to_numpy(float), place, int(rows["gap"].iloc[0]), jump)
        key = (rows["kpi"].iloc[0], rows["region"].iloc[0])
        return pd.DataFrame(
            [(*key, rows["metric_date"].iloc[i], before, after, after - before, METHOD) for i, before, after in found],
            columns=NAMES)
    return run


def detect(series: DataFrame, mart: DataFrame, contracts: dict[str, Contract], gap_unit: str = "rows", jump: int = kernels.JUMP) -> DataFrame:
    """Changepoints of every series with enough history; breakpoints lie on multiples of ``jump`` rows.

    A group is one daily series, so its size is bounded by the number of calendar days
    however many raw facts a region has; parallelism is the number of series.
    """
    enough = history_sufficiency(mart, "metric_date", ["region"]).filter("status = 'sufficient_history'")
    gap = F.element_at(F.create_map(*[x for c in contracts.values()
                                      for x in (F.lit(c.kpi), F.lit(c.max_lag + GAP_BUFFER))]), F.col("kpi"))
    rows = (
        series.filter(F.col("value").isNotNull()).join(enough.select("region"), "region", "left_semi")
        .select("kpi", "region", "metric_date", F.unix_date("metric_date").alias("day"), "value", gap.alias("gap"))
    )
    return rows.groupBy("kpi", "region").applyInPandas(_detect(gap_unit, jump), SCHEMA)
