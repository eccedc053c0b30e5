"""Daily KPI mart: one row per (metric_date, region)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DAY = ["metric_date", "region"]
MARGIN_ROLES = ("Executive", "Finance")


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields NULL for a zero divisor."""
    return top / F.nullif(bottom, F.lit(0.0))


def week_of(day: str | Column) -> Column:
    return F.to_date(F.date_trunc("week", F.col(day) if isinstance(day, str) else day))


def sales_daily(sales: DataFrame) -> DataFrame:
    revenue = F.sum("net_revenue").cast("double")
    units = F.sum("units_sold").cast("double")
    cost = F.sum(F.col("units_sold") * F.col("unit_cost")).cast("double")
    return sales.groupBy(F.col("sale_date").alias("metric_date"), "region").agg(
        revenue.alias("revenue"),
        units.alias("units_sold"),
        ratio(revenue, units).alias("average_selling_price"),
        F.avg(F.col("discount_pct").cast("double")).alias("average_discount_pct"),
        F.avg(F.when(F.col("inventory_units") >= F.col("reorder_point"), 1.0).otherwise(0.0))
        .alias("stock_availability"),
        ratio(revenue - cost, revenue).alias("margin_pct"),
        F.max("source_loaded_at").alias("sales_freshness"),
    )


def marketing_daily(marketing: DataFrame) -> DataFrame:
    total = lambda c: F.sum(c).cast("double")
    return marketing.groupBy(F.col("activity_date").alias("metric_date"), "region").agg(
        total("spend").alias("marketing_spend"),
        total("sessions").alias("sessions"),
        total("orders").alias("orders"),
        total("new_customers").alias("new_customers"),
        ratio(total("orders"), total("sessions")).alias("conversion_rate"),
        ratio(total("spend"), total("new_customers")).alias("customer_acquisition_cost"),
        F.max("source_loaded_at").alias("marketing_freshness"),
    )


def success_daily(success: DataFrame) -> DataFrame:
    return success.select(
        F.col("activity_date").alias("metric_date"), "region",
        F.col("active_customers").cast("double").alias("total_active_customers"),
        F.col("churned_customers").cast("double").alias("churned_customers"),
        F.col("support_tickets").cast("double").alias("support_ticket_volume"),
        F.col("platform_uptime_pct").cast("double").alias("platform_uptime_pct"),
        F.col("source_loaded_at").alias("success_freshness"),
    )


def spine(sales: DataFrame, marketing: DataFrame, success: DataFrame) -> DataFrame:
    """Distinct (metric_date, region) seen by any daily feed."""
    days = [sales.select(F.col("sale_date").alias("metric_date"), "region"),
            marketing.select(F.col("activity_date").alias("metric_date"), "region"),
            success.select(F.col("activity_date").alias("metric_date"), "region")]
    return days[0].unionByName(days[1]).unionByName(days[2]).distinct()


def daily_mart(sales: DataFrame, marketing: DataFrame, context: DataFrame, success: DataFrame) -> DataFrame:
    """Wide mart; a missing feed stays NULL, never 0.

    Stacking the three daily aggregates and collapsing them once gives the spine and
    its left joins in a single shuffle, and reads each raw fact once.
    """
    feeds = [sales_daily(sales), marketing_daily(marketing), success_daily(success)]
    stacked = feeds[0]
    for feed in feeds[1:]:
        stacked = stacked.unionByName(feed, allowMissingColumns=True)
    values = [c for c in stacked.columns if c not in DAY]
    wide = stacked.groupBy(*DAY).agg(*[F.max(c).alias(c) for c in values])
    return with_week_context(wide, context)


def with_week_context(daily: DataFrame, context: DataFrame) -> DataFrame:
    """Attach the weekly feed to each day of its week."""
    weekly = context.select(
        "week_start", "region",
        F.col("competitor_price_index").cast("double").alias("competitor_price_index"),
        F.col("weather_index").cast("double").alias("weather_index"), "event_type",
        F.col("source_type").alias("context_source_type"),
        F.col("source_loaded_at").alias("context_freshness"))
    return daily.withColumn("week_start", week_of("metric_date")).join(
        weekly, ["week_start", "region"], "left").drop("week_start")


def source_freshness(**facts: DataFrame) -> DataFrame:
    """Latest load time and row count per source."""
    out = None
    for name, df in facts.items():
        one = df.agg(F.max("source_loaded_at").alias("latest_loaded_at"), F.count("*").alias("row_count")) \
                .select(F.lit(name).alias("source_name"), "latest_loaded_at", "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def row_counts(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def latest_health(health: DataFrame) -> DataFrame:
    """The latest health row per (source, region), by a combinable maximum."""
    rest = [c for c in health.columns if c not in ("source_name", "region", "health_date")]
    return (
        health.groupBy("source_name", "region")
        .agg(F.max(F.struct("health_date", *rest)).alias("h"))
        .select("source_name", "region", "h.*")
    )


def current_registry(registry: DataFrame) -> DataFrame:
    return registry.filter("is_current").drop("is_current")


def calendar_daily(calendar: DataFrame) -> DataFrame:
    return calendar.withColumnRenamed("calendar_date", "metric_date")


def ambiguous_weeks(context: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (region, week_start) whose week carries an ambiguous event."""
    hit = context.filter(F.col("event_type") == "ambiguous_local_event").select("region", "week_start", "event_type")
    return wanted.join(hit, ["region", "week_start"]).withColumn("requires_clarification", F.lit(True))


def history_sufficiency(df: DataFrame, day: str, keys: list[str], minimum: int = 60) -> DataFrame:
    """Distinct observed days per key; two combinable steps instead of one distinct set per key."""
    return (
        df.select(day, *keys).distinct().groupBy(*keys).agg(F.count("*").alias("observed_days"))
        .withColumn("status", F.when(F.col("observed_days") < minimum, "sparse_history")
                    .otherwise("sufficient_history"))
    )


def product_coverage(sales: DataFrame) -> DataFrame:
    return (
        sales.select("region", "product_id", "sale_date").distinct().groupBy("region", "product_id")
        .agg(F.min("sale_date").alias("first_date"), F.max("sale_date").alias("last_date"),
             F.count("*").alias("observed_days"))
    )


def grain_duplicates(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """How many primary keys occur more than once, as one row."""
    return (
        df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
        .agg(F.count("*").alias("duplicate_grains"))
        .select(F.lit(name).alias("table_name"), "duplicate_grains")
    )


def calendar_gaps(df: DataFrame, day: str, keys: list[str]) -> DataFrame:
    """Days inside a key's own date range on which it has no row."""
    seen = df.select(day, *keys).distinct()
    step = W.partitionBy(*keys).orderBy(day)
    return (
        seen.withColumn("next_day", F.lead(day).over(step))
        .filter(F.datediff("next_day", day) > 1)
        .select(*keys, F.explode(F.sequence(F.date_add(day, 1), F.date_sub("next_day", 1))).alias("missing_date"))
    )


def rule_violations(name: str, df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule; all rules of a table share one scan."""
    counts = df.agg(*[F.count_if(~rule).alias(label) for label, rule in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations").select(F.lit(name).alias("table_name"),
                                                                      "rule", "violations")


def window_means(facts: DataFrame, windows: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric in named windows (label, region, start_date, end_date)."""
    days = windows.select("label", "region", F.explode(F.sequence("start_date", "end_date")).alias("metric_date"))
    return days.join(facts, ["region", "metric_date"]).groupBy("label", "region").agg(
        *[F.avg(m).alias(m) for m in metrics])


def slices(mart: DataFrame, picks: list[tuple[str, str, str]], columns: list[str]) -> DataFrame:
    """Rows of the mart in any of the (region, first day, last day) picks."""
    cond = F.lit(False)
    for region, start, end in picks:
        cond = cond | ((F.col("region") == region)
                       & F.col("metric_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return mart.filter(cond).select(*DAY, *columns)


def for_role(mart: DataFrame, role: str) -> DataFrame:
    """Hide margin columns from roles that may not see them."""
    if role in MARGIN_ROLES:
        return mart
    return mart.drop(*[c for c in mart.columns if c.startswith("margin")])


def recent_margin(mart: DataFrame, rows: int = 30) -> DataFrame:
    """The last rows per region; Spark prunes each task to ``rows`` before the shuffle."""
    rank = F.row_number().over(W.partitionBy("region").orderBy(F.desc("metric_date")))
    return mart.select("region", "metric_date", "margin_pct", rank.alias("rn")).filter(F.col("rn") <= rows).drop("rn")
