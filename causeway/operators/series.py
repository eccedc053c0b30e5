"""KPI series, local shifts, incidents and their windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.sources.contracts import Contract

INCIDENT = ["kpi", "region", "window_start"]

# Window lengths in days.
LOOKBACK = 90
GAP = 7
INCIDENT_DAYS = 10
SEGMENT = 10
GAP_BUFFER = 7


def kpi_value(contract: Contract) -> Column:
    cols = [F.col(c).cast("double") for _, c in contract.components]
    if contract.operator == "multiply":
        return cols[0] * cols[1]
    if contract.operator == "divide":
        return cols[0] / F.nullif(cols[1], F.lit(0.0))
    return cols[0]


def kpi_series(mart: DataFrame, contracts: dict[str, Contract]) -> DataFrame:
    """(kpi, region, metric_date, value); a narrow projection, no shuffle."""
    cells = F.array(*[F.struct(F.lit(c.kpi).alias("kpi"), kpi_value(c).alias("value")) for c in contracts.values()])
    return mart.select("region", "metric_date", F.explode(cells).alias("cell")).select(
        "cell.kpi", "region", "metric_date", "cell.value")


def by_series(*more: str):
    return W.partitionBy("kpi", "region", *more).orderBy("metric_date")


def first_difference(series: DataFrame) -> DataFrame:
    seen = series.filter(F.col("value").isNotNull())
    return seen.withColumn("difference", F.col("value") - F.lag("value").over(by_series())) \
               .filter(F.col("difference").isNotNull())


def local_shifts(series: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Mean of the next rows minus mean of the previous rows at every position with full segments."""
    seen = series.filter(F.col("value").isNotNull())
    before, after = by_series().rowsBetween(-segment, -1), by_series().rowsBetween(0, segment - 1)
    return (
        seen.select("kpi", "region", "metric_date",
                    F.avg("value").over(before).alias("segment_mean_before"),
                    F.avg("value").over(after).alias("segment_mean_after"),
                    F.count("value").over(before).alias("n_before"),
                    F.count("value").over(after).alias("n_after"))
        .filter((F.col("n_before") == segment) & (F.col("n_after") == segment)).drop("n_before", "n_after")
        .withColumn("shift_magnitude", F.col("segment_mean_after") - F.col("segment_mean_before"))
    )


def largest_shifts(shifts: DataFrame) -> DataFrame:
    """The date of the largest absolute shift per (kpi, region, year); earliest date on a tie."""
    best = F.max_by("metric_date", F.struct(F.round(F.abs("shift_magnitude"), 6), -F.unix_date("metric_date")))
    return shifts.groupBy("kpi", "region", F.year("metric_date").alias("year")).agg(
        best.alias("window_start")).select(*INCIDENT)


def window_bounds(incidents: DataFrame) -> DataFrame:
    end = F.date_sub("window_start", GAP + 1)
    return incidents.select(
        *INCIDENT, F.date_sub(end, LOOKBACK).alias("history_start"), end.alias("history_end"),
        F.col("window_start").alias("incident_start"),
        F.date_add("window_start", INCIDENT_DAYS).alias("incident_end"))


def incident_days(incidents: DataFrame) -> DataFrame:
    """One row per incident and calendar day it may read: history, gap and incident."""
    first = F.date_sub("window_start", GAP + 1 + LOOKBACK)
    return (
        incidents.select(*INCIDENT, F.explode(F.sequence(first, F.date_add("window_start", INCIDENT_DAYS)))
                         .alias("metric_date"))
        .withColumn("role", F.when(F.col("metric_date") <= F.date_sub("window_start", GAP + 1), "history")
                    .when(F.col("metric_date") >= F.col("window_start"), "incident").otherwise("gap"))
    )


def incident_windows(incidents: DataFrame, mart: DataFrame, columns: list[str]) -> DataFrame:
    """Mart rows of every incident window.

    Days are exploded first, so the range join becomes an equi join on (region, day):
    work is linear in incidents and no region is compared with all of its days.
    """
    return incident_days(incidents).join(mart.select("region", "metric_date", *columns), ["region", "metric_date"])


def event_flag(column: str, name: str) -> Column:
    """An event label as 0/1; a missing label counts as 0."""
    return F.when(F.coalesce(F.col(column), F.lit("")) == name, 1.0).otherwise(0.0)


def metric(column: str, name: str) -> Column:
    return event_flag(column, name) if column == "event_type" else F.col(column).cast("double")


def contract_columns(contracts: dict[str, Contract]) -> list[str]:
    cols = {c for k in contracts.values() for _, c in k.components}
    return sorted(cols | {d.column for k in contracts.values() for d in k.drivers})


def per_kpi(contracts: dict[str, Contract], build) -> Column:
    """A per-row array chosen by the row's KPI."""
    out = None
    for c in contracts.values():
        cond, cells = F.col("kpi") == c.kpi, build(c)
        out = F.when(cond, cells) if out is None else out.when(cond, cells)
    return out


def component_rows(windows: DataFrame, contracts: dict[str, Contract]) -> DataFrame:
    """Long form: one row per incident, day and component."""
    cells = per_kpi(contracts, lambda c: F.array(*[
        F.struct(F.lit(n).alias("component"), F.lit(i).alias("ordinal"), metric(col, n).alias("value"))
        for i, (n, col) in enumerate(c.components)]))
    return windows.select(*INCIDENT, "metric_date", "role", F.explode(cells).alias("c")).select(
        *INCIDENT, "metric_date", "role", "c.*")


def pair_rows(windows: DataFrame, contracts: dict[str, Contract]) -> DataFrame:
    """Long form: one row per incident, day, component and driver, with both values."""
    def build(c: Contract) -> Column:
        where = dict(c.components)
        return F.array(*[
            F.struct(F.lit(d.explains).alias("component"), F.lit(d.name).alias("driver"),
                     F.lit(i).alias("ordinal"), F.lit(d.max_lag).alias("max_lag"),
                     F.lit(d.cadence).alias("cadence"), F.lit(d.steps).alias("steps"),
                     F.lit(c.max_lag).alias("context_days"),
                     metric(d.column, d.name).alias("x"), metric(where[d.explains], d.explains).alias("y"))
            for i, d in enumerate(c.drivers)])
    return windows.select(*INCIDENT, "metric_date", "role", F.explode(per_kpi(contracts, build)).alias("p")).select(
        *INCIDENT, "metric_date", "role", "p.*")


def leakage(windows: DataFrame) -> DataFrame:
    """Incidents whose history reaches the changepoint or whose incident rows precede it."""
    return windows.groupBy(*INCIDENT).agg(
        F.max(F.when(F.col("role") == "history", F.col("metric_date"))).alias("last_history"),
        F.min(F.when(F.col("role") == "incident", F.col("metric_date"))).alias("first_incident"),
    ).withColumn("violation", F.coalesce((F.col("last_history") >= F.col("window_start"))
                                         | (F.col("first_incident") < F.col("window_start")), F.lit(False)))


def half_window_means(components: DataFrame) -> DataFrame:
    """Level of each component late in the history and late in the incident.

    n non-null rows: history uses rows from n // 2; incident uses rows from max(1, n // 2),
    or the only row when n = 1. No rows gives 0.
    """
    def level(role: str) -> Column:
        rows = F.sort_array(F.collect_list(F.when(
            (F.col("role") == role) & F.col("value").isNotNull(), F.struct("metric_date", "value"))))
        n = F.size(rows)
        skip = F.floor(n / 2).cast("int")
        late = F.slice(rows, skip + 1, F.greatest(n - skip, F.lit(1)))
        total = F.aggregate(late, F.lit(0.0), lambda acc, r: acc + r["value"])
        return F.when(n == 0, 0.0).otherwise(total / F.greatest(F.size(late), F.lit(1)))
    return components.filter("role <> 'gap'").groupBy(*INCIDENT, "component", "ordinal").agg(
        level("history").alias("baseline"), level("incident").alias("incident"),
        F.count(F.when(F.col("role") == "history", 1)).alias("history_rows"),
        F.count(F.when(F.col("role") == "incident", 1)).alias("incident_rows"))
