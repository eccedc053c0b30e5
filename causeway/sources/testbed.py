"""Adapter: the order-processing test tables expressed as the raw fact schema.

The placed orders and the four daily facts are written once, and everything after reads them.
Money is summed exactly, as whole cents, so that sums do not depend on row order. Nothing here
is broadcast by hand: Spark decides from measured sizes.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from causeway.functions.table import content_sum, given, observed_print, print_sums, taken
from causeway.session import write_layer

PRICE_BASE = 250_000.0
REORDER_PER_LINE = 25
EXPECTED_ROWS = {"sales": 3, "marketing": 1, "customer_success": 1, "market_context": 1}


def scaled(name: str, unit: int):
    """A two- or four-digit figure as a whole number of 1/unit, so that sums stay in long arithmetic."""
    return F.rint(F.col(name) * unit).cast("bigint")


def money(total, unit: str):
    """A whole-number total back as an exact DECIMAL."""
    return total.cast("decimal(20,0)") * F.lit(unit).cast("decimal(8,8)")


def comparable(df: DataFrame) -> list:
    """A fact's columns as texts that are the same everywhere: figures as whole numbers, times as days."""
    def text(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            return (c * 10 ** 6).cast("decimal(38,0)")
        if isinstance(f.dataType, T.DoubleType):
            return scaled(f.name, 10 ** 6)
        return F.to_date(c) if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else c
    return [F.coalesce(text(f).cast("string"), F.lit("\u0000")) for f in df.schema.fields]


@dataclass
class Testbed:
    """Raw facts read lazily from one folder of Parquet tables."""

    spark: SparkSession
    path: str
    taken: dict[str, tuple] = field(default_factory=dict)

    __test__ = False

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def placed_orders(self) -> DataFrame:
        """The needed columns of the orders with the customer's region, written once."""
        place = (
            self.table("customer").select("c_custkey", "c_nationkey")
            .join(self.table("nation").select("n_nationkey", "n_regionkey"), F.expr("c_nationkey = n_nationkey"))
            .join(self.table("region"), F.expr("n_regionkey = r_regionkey"))
            .select(F.col("c_custkey").alias("o_custkey"), F.col("r_name").alias("region"))
        )
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")
        return write_layer(orders.join(place.hint("shuffle_hash"), "o_custkey").withColumn("day", F.to_date("o_orderdate")), "placed-orders")

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """A fact as a layer; its print is taken in the same pass."""
        rows, seen = observed_print(df, comparable(df))
        layer = write_layer(rows, name.replace("_", "-"))
        self.taken[name] = taken(seen)
        return layer

    def stored_prints(self) -> DataFrame:
        """(table_name, row_count, content_sum) of the daily facts, as taken while they were written."""
        self.ready()
        rows = given(self.spark, [(name, *self.taken[name]) for name in EXPECTED_ROWS],
                     "table_name string, row_count long, high decimal(38,0), low decimal(38,0)")
        return rows.select("table_name", "row_count", content_sum(F.col("high"), F.col("low")).alias("content_sum"))

    def prints(self) -> DataFrame:
        """The same of the facts as they are now."""
        facts = {name: getattr(self, name) for name in EXPECTED_ROWS}
        return reduce(lambda a, b: a.unionByName(b), [
            df.agg(*print_sums(comparable(df))).select(F.lit(name).alias("table_name"), "row_count",
                                                       content_sum(F.col("high"), F.col("low")).alias("content_sum"))
            for name, df in facts.items()])

    def ready(self) -> Testbed:
        """Write the four daily facts side by side, where they are not written yet."""
        self.placed_orders  # noqa: B018
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda name: getattr(self, name), EXPECTED_ROWS))
        return self

    @cached_property
    def sales(self) -> DataFrame:
        where = self.placed_orders.select(F.col("o_orderkey").alias("l_orderkey"), "region")
        part = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size",
            F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
        rate = scaled("l_discount", 10_000)
        return self.written(
            self.table("lineitem").join(where.hint("shuffle_hash"), "l_orderkey").join(part, "l_partkey")
            .groupBy(F.to_date("l_shipdate").alias("sale_date"), "region", F.col("p_brand").alias("product_id"))
            .agg(
                F.sum(F.col("l_quantity").cast("bigint")).alias("units_sold"),
                F.max("price").alias("list_price"),
                F.min("price").alias("unit_cost"),
                money(F.max(rate), "0.0001").cast("decimal(5,4)").alias("discount_pct"),
                money(F.sum(scaled("l_extendedprice", 100) * (10_000 - rate)), "0.000001").alias("net_revenue"),
                F.sum(F.col("p_size").cast("bigint")).alias("inventory_units"),
                (F.count("*") * REORDER_PER_LINE).alias("reorder_point"),
                F.max("l_shipdate").alias("source_loaded_at"),
            ), "sales")

    @cached_property
    def marketing(self) -> DataFrame:
        orders = self.placed_orders
        keys = ["activity_date", "region", "channel"]
        placed = (
            orders.groupBy(F.col("day").alias("activity_date"), "region", F.col("o_orderpriority").alias("channel"))
            .agg(
                money(F.sum(scaled("o_totalprice", 100)) * 5, "0.0001").alias("spend"),
                (F.count("*") * 20).alias("impressions"),
                F.sum(1 + F.col("o_orderkey") % 7).alias("sessions"),
                F.count("*").alias("orders"),
                F.lit(0).cast("bigint").alias("new_customers"),
                F.max("o_orderdate").alias("source_loaded_at"),
            )
        )
        # A customer's first order, found by a combinable minimum rather than a window.
        first = (
            orders.groupBy("o_custkey")
            .agg(F.min(F.struct("o_orderdate", "o_orderkey", "day", "region", "o_orderpriority")).alias("f"))
            .groupBy(F.col("f.day").alias("activity_date"), F.col("f.region").alias("region"),
                     F.col("f.o_orderpriority").alias("channel"))
            .agg(F.count("*").alias("new_customers"))
        )
        return self.written(
            placed.unionByName(first, allowMissingColumns=True).groupBy(*keys)
            .agg(*[F.sum(c).alias(c) for c in ("spend", "impressions", "sessions", "orders", "new_customers")],
                 F.max("source_loaded_at").alias("source_loaded_at")), "marketing")

    @cached_property
    def market_context(self) -> DataFrame:
        urgent = F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0))
        slow = F.avg(F.when(F.col("o_orderpriority") == "5-LOW", 1.0).otherwise(0.0))
        return self.written(
            self.placed_orders
            .groupBy(F.to_date(F.date_trunc("week", F.col("day"))).alias("week_start"), "region")
            .agg(
                (money(F.sum(scaled("o_totalprice", 100)), "0.01").cast("double") / F.count("*") / F.lit(PRICE_BASE))
                .alias("competitor_price_index"),
                (F.lit(0.8) + slow).alias("weather_index"),
                F.when(urgent > 0.3, "ambiguous_local_event").alias("event_type"),
                F.lit("scheduled_feed").alias("source_type"),
                F.max("o_orderdate").alias("source_loaded_at"),
            ), "market_context")

    @cached_property
    def customer_success(self) -> DataFrame:
        flag = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
        per_customer = self.placed_orders.groupBy(F.col("day").alias("activity_date"), "region", "o_custkey").agg(
            F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("lost"),
            flag(F.col("o_orderpriority") == "1-URGENT").alias("tickets"),
            flag(F.col("o_orderstatus") == "P").alias("partial"),
            F.count("*").alias("n"), F.max("o_orderdate").alias("at"))
        return self.written(per_customer.groupBy("activity_date", "region").agg(
            F.count("*").alias("active_customers"),
            F.sum("lost").alias("churned_customers"),
            F.sum("tickets").alias("support_tickets"),
            (1.0 - 0.1 * F.sum("partial") / F.sum("n")).alias("platform_uptime_pct"),
            F.max("at").alias("source_loaded_at")), "customer_success")

    @cached_property
    def source_health(self) -> DataFrame:
        feeds = {"sales": (self.sales, "sale_date"), "marketing": (self.marketing, "activity_date"),
                 "customer_success": (self.customer_success, "activity_date"),
                 "market_context": (self.market_context, "week_start")}
        seen = None
        for name, (df, day) in feeds.items():
            size = F.sum("active_customers") if name == "customer_success" else F.count("*")
            one = df.groupBy(F.col(day).alias("health_date"), "region").agg(size.alias("n")).select(
                "health_date", F.lit(name).alias("source_name"), "region", "n",
                F.lit(EXPECTED_ROWS[name]).alias("expected"),
                F.lit(168 if name == "market_context" else 24).alias("expected_cadence_hours"))
            seen = one if seen is None else seen.unionByName(one)
        prior = F.lag("health_date").over(W.partitionBy("source_name", "region").orderBy("health_date"))
        lag_hours = F.coalesce(F.greatest(F.datediff("health_date", prior) * 24 - F.col("expected_cadence_hours"),
                                          F.lit(0)), F.lit(0)) + 6
        return (
            seen.withColumn("observed_lag_hours", lag_hours.cast("double"))
            .withColumn("completeness_pct", F.least(F.lit(100.0), F.lit(100.0) * F.col("n") / F.col("expected")))
            .select("health_date", "source_name", "region", "expected_cadence_hours", "observed_lag_hours",
                    "completeness_pct", F.lit("v1").alias("schema_version"),
                    F.when((F.col("completeness_pct") < 50) | (F.col("observed_lag_hours") > 96), "stale")
                    .otherwise("healthy").alias("status"))
        )

    @cached_property
    def business_calendar(self) -> DataFrame:
        return (
            self.placed_orders.groupBy(F.col("day").alias("calendar_date"), "region",
                                       F.col("o_orderpriority").alias("event_name"))
            .agg(F.count("*").alias("n"))
            .select("calendar_date", "region", "event_name", F.lit("order_peak").alias("event_type"),
                    F.when(F.col("n") > 1, "up").alias("expected_direction"),
                    (F.col("n") % 2 == 0).alias("is_known_in_advance"))
        )

    @cached_property
    def metric_registry(self) -> DataFrame:
        return self.table("part").select(
            F.concat_ws(":", "p_type", "p_name").alias("metric_name"),
            F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("definition_version"),
            F.col("p_brand").alias("owner_team"),
            F.col("p_name").alias("formula_text"), F.lit("day").alias("grain"),
            (F.col("p_size") >= 25).alias("is_current"))

    def feedback(self, patterns: list[tuple[str, str, str]]) -> DataFrame:
        """Events as user feedback about decision patterns (kpi, primary_driver, action_level)."""
        known = F.broadcast(given(
            self.spark, [(i, *p) for i, p in enumerate(patterns)],
            "slot bigint, kpi string, primary_driver string, action_level string"))
        regions = self.table("region").select(F.col("r_regionkey").cast("bigint").alias("rk"),
                                              F.col("r_name").alias("region"))
        word = F.element_at(F.create_map(*[F.lit(x) for x in (
            "purchase", "Helpful", "click", " helpful ", "signup", "Unclear", "error", "Not helpful")]),
            F.col("event_type"))
        return (
            self.table("events")
            .withColumn("rk", F.col("user_id") % 5).join(regions, "rk")
            .withColumn("slot", F.col("event_id") % len(patterns))
            .join(known, "slot")
            .select("event_id", F.col("ts").alias("created_at"), "region", "kpi",
                    "primary_driver", "action_level",
                    F.coalesce(word, F.lit("seen")).alias("disposition"),
                    F.col("props").alias("comment_text"), (F.col("user_id") % 7 == 0).alias("is_demo"))
        )

    def raw_tables(self) -> dict[str, DataFrame]:
        """The tables that the facts are made of, in columns whose text form is the same everywhere."""
        cents = lambda c: scaled(c, 100).alias(c)
        day = lambda c: F.to_date(c).alias(c)
        return {
            "orders": self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", cents("o_totalprice"), day("o_orderdate"), "o_orderpriority"),
            "lineitem": self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cents("l_quantity"), cents("l_extendedprice"),
                                                      cents("l_discount"), day("l_shipdate")),
            "customer": self.table("customer").select("c_custkey", "c_nationkey"),
            "part": self.table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", cents("p_retailprice")),
            "nation": self.table("nation").select("n_nationkey", "n_name", "n_regionkey"),
            "region": self.table("region").select("r_regionkey", "r_name"),
        }

    @cached_property
    def telemetry(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.col("ts").alias("created_at"), F.col("event_type").alias("operation_name"),
            F.floor(F.col("value") * 10).alias("latency_ms"),
            F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"))
