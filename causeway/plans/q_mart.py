"""Queries over the raw facts, the mart, the KPI series and the decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions.table import fingerprint, one_row
from causeway.operators import decompose as D
from causeway.operators import mart as M
from causeway.operators import series as S
from causeway.plans.catalog import query, show
from causeway.plans.workspace import Workspace

KEYS = "kpi region window_start"
SPLIT_NUMS = "total_change effect_a effect_b interaction_effect residual"
GRAINS = {
    "sales": ["sale_date", "region", "product_id"], "marketing": ["activity_date", "region", "channel"],
    "market_context": ["week_start", "region"], "customer_success": ["activity_date", "region"],
    "source_health": ["health_date", "source_name", "region"],
    "business_calendar": ["calendar_date", "region", "event_name"],
    "metric_registry": ["metric_name", "definition_version"],
}
SLICES = [("ASIA", "1996-04-12", "1996-06-22"), ("EUROPE", "1997-06-07", "1997-09-18"),
          ("AFRICA", "1999-11-27", "2000-02-07")]


@query
def mart_daily(w: Workspace) -> DataFrame:
    return show(w.mart_plan, "metric_date region event_type",
                "revenue units_sold average_selling_price average_discount_pct stock_availability margin_pct "
                "marketing_spend sessions orders new_customers conversion_rate customer_acquisition_cost "
                "competitor_price_index weather_index total_active_customers churned_customers "
                "support_ticket_volume platform_uptime_pct", 5)


@query
def spine_union(w: Workspace) -> DataFrame:
    return M.spine(w.facts.sales, w.facts.marketing, w.facts.customer_success)


@query
def sales_rollup(w: Workspace) -> DataFrame:
    return show(M.sales_daily(w.facts.sales).withColumn("fresh_on", F.to_date("sales_freshness")),
                "metric_date region fresh_on", "revenue units_sold average_selling_price "
                "average_discount_pct stock_availability margin_pct", 5)


@query
def marketing_rollup(w: Workspace) -> DataFrame:
    return show(M.marketing_daily(w.facts.marketing), "metric_date region",
                "marketing_spend sessions orders new_customers conversion_rate customer_acquisition_cost", 5)


@query
def weekly_context_join(w: Workspace) -> DataFrame:
    days = w.facts.customer_success.select(F.col("activity_date").alias("metric_date"), "region")
    return show(M.with_week_context(days, w.facts.market_context),
                "metric_date region event_type context_source_type", "competitor_price_index weather_index")


@query
def ambiguous_context_weeks(w: Workspace) -> DataFrame:
    wanted = w.facts.customer_success.select("region", M.week_of("activity_date").alias("week_start")).distinct()
    return M.ambiguous_weeks(w.facts.market_context, wanted)


@query
def source_freshness(w: Workspace) -> DataFrame:
    f = w.facts
    return M.source_freshness(sales=f.sales, marketing=f.marketing, market_context=f.market_context,
                              customer_success=f.customer_success) \
            .select("source_name", F.to_date("latest_loaded_at").alias("latest_loaded_on"), "row_count")


@query
def source_health_latest(w: Workspace) -> DataFrame:
    return show(M.latest_health(w.facts.source_health), "source_name region health_date status",
                "observed_lag_hours completeness_pct")


@query
def metric_registry_current(w: Workspace) -> DataFrame:
    return M.current_registry(w.facts.metric_registry)


@query
def business_calendar_daily(w: Workspace) -> DataFrame:
    return M.calendar_daily(w.facts.business_calendar)


@query
def history_sufficiency_region(w: Workspace) -> DataFrame:
    return M.history_sufficiency(w.mart, "metric_date", ["region"])


@query
def history_sufficiency_product(w: Workspace) -> DataFrame:
    return M.history_sufficiency(w.facts.sales, "sale_date", ["region", "product_id"])


@query
def product_coverage(w: Workspace) -> DataFrame:
    return M.product_coverage(w.facts.sales)


@query
def table_row_counts(w: Workspace) -> DataFrame:
    return M.row_counts(mart=w.mart, **{n: getattr(w.facts, n) for n in GRAINS})


@query
def grain_duplicates(w: Workspace) -> DataFrame:
    out = M.grain_duplicates("lineitem", w.facts.table("lineitem"), ["l_orderkey", "l_linenumber"])
    for name, keys in GRAINS.items():
        out = out.unionByName(M.grain_duplicates(name, getattr(w.facts, name), keys))
    return out


@query
def calendar_gaps(w: Workspace) -> DataFrame:
    return M.calendar_gaps(w.facts.marketing, "activity_date", ["region", "channel"])


@query
def domain_violations(w: Workspace) -> DataFrame:
    c, f = F.col, w.facts
    return (
        M.rule_violations("sales", f.sales, {
            "units_sold_nonnegative": c("units_sold") >= 0, "inventory_nonnegative": c("inventory_units") >= 0,
            "discount_between_0_and_1": c("discount_pct").between(0, 1),
            "inventory_covers_reorder": c("inventory_units") >= c("reorder_point")})
        .unionByName(M.rule_violations("marketing", f.marketing, {
            "spend_nonnegative": c("spend") >= 0, "orders_within_sessions": c("orders") <= c("sessions"),
            "new_customers_within_orders": c("new_customers") <= c("orders")}))
        .unionByName(M.rule_violations("market_context", f.market_context, {
            "price_index_range": c("competitor_price_index").between(0.5, 1.5),
            "weather_index_range": c("weather_index").between(0.2, 1.5)}))
        .unionByName(M.rule_violations("customer_success", f.customer_success, {
            "uptime_range": c("platform_uptime_pct").between(0, 1),
            "churned_within_active": c("churned_customers") <= c("active_customers")}))
    )


@query
def window_mean_compare(w: Workspace) -> DataFrame:
    """Means of the eight days before and after each incident."""
    hits = w.incidents
    pre = hits.select(F.concat(F.lit("pre "), F.col("kpi"), F.lit(" "), F.col("window_start").cast("string")).alias("label"), "region",
                      F.date_sub("window_start", 8).alias("start_date"), F.date_sub("window_start", 1).alias("end_date"))
    post = hits.select(F.concat(F.lit("post "), F.col("kpi"), F.lit(" "), F.col("window_start").cast("string")).alias("label"), "region",
                       F.col("window_start").alias("start_date"), F.date_add("window_start", 7).alias("end_date"))
    metrics = ["revenue", "stock_availability", "marketing_spend", "conversion_rate"]
    return show(M.window_means(w.mart, pre.unionByName(post), metrics), "label region", " ".join(metrics), 4)


@query
def incident_slices(w: Workspace) -> DataFrame:
    cols = ["revenue", "units_sold", "stock_availability", "weather_index"]
    return show(M.slices(w.mart, SLICES, cols), "metric_date region", " ".join(cols), 5)


@query
def recent_margin(w: Workspace) -> DataFrame:
    return show(M.recent_margin(M.for_role(w.mart, "Finance")), "region metric_date", "margin_pct")


@query
def table_fingerprint(w: Workspace) -> DataFrame:
    out = None
    vectors = w.facts.table("embeddings")
    vectors = vectors.select(*[F.transform(f.name, lambda x: F.rint(x.cast("double") * 1e6).cast("bigint")).alias(f.name)
                               if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in vectors.schema.fields])
    tables = {name: w.facts.table(name) for name in ("documents", "pages", "benchmark", "labels", "conversations")}
    for name, df in {**tables, "embeddings": vectors, **w.facts.raw_tables()}.items():
        one = fingerprint(df, "md5").withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query
def kpi_series(w: Workspace) -> DataFrame:
    return show(w.series, "kpi region metric_date", "value", 5)


@query
def first_difference(w: Workspace) -> DataFrame:
    return show(S.first_difference(w.series), "kpi region metric_date", "difference", 5)


@query
def local_shift(w: Workspace) -> DataFrame:
    return show(w.shifts, "kpi region metric_date", "segment_mean_before segment_mean_after shift_magnitude", 4)


@query
def largest_shifts(w: Workspace) -> DataFrame:
    return w.incidents


@query
def window_bounds(w: Workspace) -> DataFrame:
    return S.window_bounds(w.incidents)


@query
def leakage_audit(w: Workspace) -> DataFrame:
    return S.leakage(w.windows)


@query
def half_window_means(w: Workspace) -> DataFrame:
    return show(w.levels, f"{KEYS} component history_rows incident_rows", "baseline incident", 5)


def _split(w: Workspace, kind: str, method: str = "shapley") -> DataFrame:
    out = D.decompose(w.sides.filter(F.col("decomposition_type") == kind), method)
    return show(out, f"{KEYS} is_volatile narrative_mode", SPLIT_NUMS, 4)


@query
def decompose_multiply(w: Workspace) -> DataFrame:
    return _split(w, "multiply")


@query
def decompose_divide(w: Workspace) -> DataFrame:
    return _split(w, "divide")


@query
def decompose_divide_forward(w: Workspace) -> DataFrame:
    return _split(w, "divide", "forward")


@query
def decompose_divide_reference(w: Workspace) -> DataFrame:
    return _split(w, "divide", "reference")


@query
def decompose_single(w: Workspace) -> DataFrame:
    return _split(w, "single")


@query
def kpi_change(w: Workspace) -> DataFrame:
    return show(w.decomposed, f"{KEYS} decomposition_type is_material", "kpi_baseline percent_change", 5)


@query
def component_impacts(w: Workspace) -> DataFrame:
    return show(w.impacts, f"{KEYS} component", "impact baseline incident", 4)


@query
def decomposition_audit(w: Workspace) -> DataFrame:
    """Exactness of every stored split; a failing row is listed with its gap."""
    failed = D.failed_sums(w.decomposed)
    return one_row(w.decomposed.agg(F.count("*").alias("checked")), failed.agg(F.count("*").alias("failures")))


@query
def incident_status(w: Workspace) -> DataFrame:
    """Every incident, with the reason where it cannot be split."""
    return D.window_status(w.incidents, w.levels)


@query
def margin_restricted(w: Workspace) -> DataFrame:
    """What a role without access to margins sees of the mart."""
    seen = M.for_role(w.mart, "Growth analyst")
    hidden = sorted(set(w.mart.columns) - set(seen.columns))
    return show(seen.withColumn("hidden", F.lit(",".join(hidden))), "metric_date region hidden", "revenue units_sold", 5)


@query
def stored_prints(w: Workspace) -> DataFrame:
    """The fingerprints of the facts, taken in the pass that wrote them."""
    return w.raw_prints
