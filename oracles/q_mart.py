"""Oracles for causeway.plans.q_mart."""

from __future__ import annotations

from oracles.base import CTE, build, decomposition  # noqa: F401

ORACLES: dict[str, str] = {}


def nums(names: str, digits: int = 6) -> str:
    """Published doubles: rounded with ties going up."""
    out = []
    for item in names.split():
        n, _, d = item.partition(":")
        d = int(d or digits)
        out.append(f"round(CAST({n} AS DOUBLE) + {3.3 * 10.0 ** -(d + 2):.3e}, {d}) + 0.0 AS {n}")
    return ", ".join(out)


def add(name: str, final: str) -> None:
    ORACLES[name] = build(final)


KEYS = "kpi, region, window_start"
SPLIT = nums("total_change effect_a effect_b interaction_effect residual", 4)
MODE = "CASE WHEN is_volatile THEN 'complex_interaction' ELSE 'standard' END AS narrative_mode"

add("mart_daily", "SELECT metric_date, region, event_type, " + nums(
    "revenue units_sold average_selling_price average_discount_pct stock_availability margin_pct "
    "marketing_spend sessions orders new_customers conversion_rate customer_acquisition_cost "
    "competitor_price_index weather_index total_active_customers churned_customers "
    "support_ticket_volume platform_uptime_pct", 5) + " FROM mart")
add("spine_union", "SELECT metric_date, region FROM spine")
add("sales_rollup", "SELECT metric_date, region, CAST(sales_freshness AS DATE) AS fresh_on, " + nums(
    "revenue units_sold average_selling_price average_discount_pct stock_availability margin_pct", 5)
    + " FROM mart WHERE revenue IS NOT NULL")
add("marketing_rollup", "SELECT metric_date, region, " + nums(
    "marketing_spend sessions orders new_customers conversion_rate customer_acquisition_cost", 5)
    + " FROM mart WHERE orders IS NOT NULL")
add("weekly_context_join", "SELECT metric_date, region, event_type, context_source_type, "
    + nums("competitor_price_index weather_index") + " FROM mart WHERE total_active_customers IS NOT NULL")
add("ambiguous_context_weeks", """
  SELECT DISTINCT c.region, c.week_start, c.event_type, TRUE AS requires_clarification
  FROM market_context c JOIN customer_success x ON x.region = c.region
   AND CAST(date_trunc('week', x.activity_date) AS DATE) = c.week_start
  WHERE c.event_type = 'ambiguous_local_event'""")
add("source_freshness", " UNION ALL ".join(
    f"SELECT '{t}' AS source_name, CAST(MAX(source_loaded_at) AS DATE) AS latest_loaded_on, COUNT(*) AS row_count FROM {t}"
    for t in ("sales", "marketing", "market_context", "customer_success")))
add("source_health_latest", "SELECT source_name, region, health_date, status, "
    + nums("observed_lag_hours completeness_pct") + """ FROM source_health h
  WHERE health_date = (SELECT MAX(health_date) FROM source_health x WHERE x.source_name = h.source_name AND x.region = h.region)""")
add("metric_registry_current", """
  SELECT p_type || ':' || p_name AS metric_name, 'v' || p_partkey AS definition_version, p_brand AS owner_team,
         p_name AS formula_text, 'day' AS grain FROM part WHERE p_size >= 25""")
add("business_calendar_daily", """
  SELECT calendar_date AS metric_date, region, event_name, 'order_peak' AS event_type,
         CASE WHEN n > 1 THEN 'up' END AS expected_direction, n % 2 = 0 AS is_known_in_advance FROM calendar""")
STATUS = "CASE WHEN observed_days < 60 THEN 'sparse_history' ELSE 'sufficient_history' END AS status"
add("history_sufficiency_region", f"""SELECT *, {STATUS} FROM
  (SELECT region, COUNT(DISTINCT metric_date) AS observed_days FROM mart GROUP BY 1)""")
add("history_sufficiency_product", f"""SELECT *, {STATUS} FROM
  (SELECT region, product_id, COUNT(DISTINCT sale_date) AS observed_days FROM sales GROUP BY 1, 2)""")
add("product_coverage", """SELECT region, product_id, MIN(sale_date) AS first_date, MAX(sale_date) AS last_date,
  COUNT(DISTINCT sale_date) AS observed_days FROM sales GROUP BY 1, 2""")
TABLES = {"mart": "mart", "sales": "sales", "marketing": "marketing", "market_context": "market_context",
          "customer_success": "customer_success", "source_health": "source_health",
          "business_calendar": "calendar", "metric_registry": "part"}
add("table_row_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS row_count FROM {t}" for n, t in TABLES.items()))
GRAINS = {"lineitem": ("lineitem", "l_orderkey, l_linenumber"), "sales": ("sales", "sale_date, region, product_id"),
          "marketing": ("marketing", "activity_date, region, channel"),
          "market_context": ("market_context", "week_start, region"),
          "customer_success": ("customer_success", "activity_date, region"),
          "source_health": ("source_health", "health_date, source_name, region"),
          "business_calendar": ("calendar", "calendar_date, region, event_name"),
          "metric_registry": ("part", "p_type, p_name, p_partkey")}
add("grain_duplicates", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS duplicate_grains FROM "
    f"(SELECT {k} FROM {t} GROUP BY {k} HAVING COUNT(*) > 1)" for n, (t, k) in GRAINS.items()))
add("calendar_gaps", """
  SELECT r.region, r.channel, r.d AS missing_date FROM (
    SELECT region, channel, CAST(UNNEST(generate_series(MIN(activity_date), MAX(activity_date), INTERVAL 1 DAY)) AS DATE) AS d
    FROM marketing GROUP BY 1, 2) r
  WHERE NOT EXISTS (SELECT 1 FROM marketing m WHERE m.region = r.region AND m.channel = r.channel AND m.activity_date = r.d)""")
RULES = [("sales", "units_sold_nonnegative", "units_sold >= 0"), ("sales", "inventory_nonnegative", "inventory_units >= 0"),
         ("sales", "discount_between_0_and_1", "discount_pct BETWEEN 0 AND 1"),
         ("sales", "inventory_covers_reorder", "inventory_units >= reorder_point"),
         ("marketing", "spend_nonnegative", "spend >= 0"), ("marketing", "orders_within_sessions", "orders <= sessions"),
         ("marketing", "new_customers_within_orders", "new_customers <= orders"),
         ("market_context", "price_index_range", "competitor_price_index BETWEEN 0.5 AND 1.5"),
         ("market_context", "weather_index_range", "weather_index BETWEEN 0.2 AND 1.5"),
         ("customer_success", "uptime_range", "platform_uptime_pct BETWEEN 0 AND 1"),
         ("customer_success", "churned_within_active", "churned_customers <= active_customers")]
add("domain_violations", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{n}' AS rule, COUNT(*) AS violations FROM {t} WHERE NOT ({r})" for t, n, r in RULES))
add("window_mean_compare", "SELECT label, region, " + nums(
    "revenue stock_availability marketing_spend conversion_rate", 4) + """ FROM (
  SELECT w.label, w.region, AVG(revenue) AS revenue, AVG(stock_availability) AS stock_availability,
         AVG(marketing_spend) AS marketing_spend, AVG(conversion_rate) AS conversion_rate
  FROM (SELECT 'pre ' || kpi || ' ' || window_start AS label, region, window_start - 8 AS s, window_start - 1 AS e FROM incidents
        UNION ALL SELECT 'post ' || kpi || ' ' || window_start, region, window_start, window_start + 7 FROM incidents) w
  JOIN mart m ON m.region = w.region AND m.metric_date BETWEEN w.s AND w.e GROUP BY 1, 2)""")
add("incident_slices", "SELECT metric_date, region, " + nums("revenue units_sold stock_availability weather_index", 5)
    + """ FROM mart WHERE (region = 'ASIA' AND metric_date BETWEEN '1996-04-12' AND '1996-06-22')
  OR (region = 'EUROPE' AND metric_date BETWEEN '1997-06-07' AND '1997-09-18')
  OR (region = 'AFRICA' AND metric_date BETWEEN '1999-11-27' AND '2000-02-07')""")
add("recent_margin", "SELECT region, metric_date, " + nums("margin_pct") + """ FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY region ORDER BY metric_date DESC) AS rn FROM mart) WHERE rn <= 30""")
def _cents(names: str) -> list[str]:
    return [f"CAST(round(CAST({n} AS DOUBLE) * 100) AS BIGINT)" for n in names.split()]


_RAW = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", *_cents("o_totalprice"), "CAST(o_orderdate AS DATE)", "o_orderpriority"],
        "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", *_cents("l_quantity l_extendedprice l_discount"), "CAST(l_shipdate AS DATE)"],
        "customer": ["c_custkey", "c_nationkey"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", *_cents("p_retailprice")],
        "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"]}
EMBEDDING = ["vec_id", "to_json(list_transform(embedding, lambda x: CAST(round_even(CAST(x AS DOUBLE) * 1e6, 0) AS BIGINT)))", "label"]
_PRINTS = {"documents": "doc_id text lang source n_chars".split(), "pages": "page_id url html".split(), "benchmark": "item_id text".split(),
           "labels": "doc_id quality toxic".split(), "conversations": "conv_id turn role text".split(), "embeddings": EMBEDDING, **_RAW}


def prints(tables: dict[str, list[str]]) -> str:
    """Row count and the sums of both halves of every row's digest."""
    half = "CAST(COALESCE(SUM(CAST(('0x' || substr(h, {0}, 16)) AS UBIGINT)::HUGEINT), 0) AS VARCHAR)"
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS row_count, {half.format(1)} || ':' || {half.format(17)} AS content_sum FROM (SELECT md5(concat_ws(chr(1), "
        + ", ".join(f"COALESCE(CAST({c} AS VARCHAR), chr(0))" for c in cols) + f")) AS h FROM {t})" for t, cols in tables.items())


add("table_fingerprint", prints(_PRINTS))
add("kpi_series", "SELECT kpi, region, metric_date, " + nums("value", 5) + " FROM series")
add("first_difference", "SELECT kpi, region, metric_date, " + nums("difference", 5) + """ FROM (
  SELECT kpi, region, metric_date, value - LAG(value) OVER (PARTITION BY kpi, region ORDER BY metric_date) AS difference
  FROM series WHERE value IS NOT NULL) WHERE difference IS NOT NULL""")
add("local_shift", "SELECT kpi, region, metric_date, "
    + nums("segment_mean_before segment_mean_after shift_magnitude", 4) + " FROM shifts")
add("largest_shifts", f"SELECT {KEYS} FROM incidents")
add("window_bounds", "SELECT * FROM bounds")
add("leakage_audit", f"""SELECT {KEYS}, last_history, first_incident,
  COALESCE(last_history >= window_start OR first_incident < window_start, FALSE) AS violation
  FROM (SELECT b.kpi, b.region, b.window_start,
          MAX(CASE WHEN m.metric_date <= b.history_end THEN m.metric_date END) AS last_history,
          MIN(CASE WHEN m.metric_date >= b.incident_start THEN m.metric_date END) AS first_incident
        FROM bounds b JOIN mart m ON m.region = b.region AND m.metric_date BETWEEN b.history_start AND b.incident_end
        GROUP BY 1, 2, 3)""")
add("half_window_means", f"SELECT {KEYS}, component, history_rows, incident_rows, " + nums("baseline incident", 5) + " FROM levels")
for _name, _kind, _method in (("decompose_multiply", "multiply", "shapley"), ("decompose_divide", "divide", "shapley"),
                              ("decompose_divide_forward", "divide", "forward"),
                              ("decompose_divide_reference", "divide", "reference"), ("decompose_single", "single", "shapley")):
    add(_name, f"SELECT {KEYS}, is_volatile, {MODE}, {SPLIT} FROM ({decomposition(_method)}) WHERE decomposition_type = '{_kind}'")
add("kpi_change", f"SELECT {KEYS}, decomposition_type, is_material, " + nums("kpi_baseline percent_change", 5)
    + " FROM (SELECT *, k0 AS kpi_baseline FROM changes)")
add("component_impacts", f"SELECT {KEYS}, component, " + nums("impact baseline incident", 4) + " FROM impacts")
add("decomposition_audit", """SELECT COUNT(*) AS checked, COUNT(*) FILTER (
  abs(effect_a + effect_b + interaction_effect + residual - total_change) > GREATEST(abs(total_change) * 0.01, 1e-6)) AS failures
  FROM decomposed""")

add("incident_status", f"""SELECT i.kpi, i.region, i.window_start, CASE WHEN h IS NULL THEN 'no_data' WHEN h = 0 THEN 'no_history'
  WHEN n = 0 THEN 'no_incident_rows' ELSE 'analysed' END AS status FROM incidents i
  LEFT JOIN (SELECT {KEYS}, MIN(history_rows) AS h, MIN(incident_rows) AS n FROM levels GROUP BY ALL) l
    ON l.kpi = i.kpi AND l.region = i.region AND l.window_start = i.window_start""")
add("margin_restricted", "SELECT metric_date, region, 'margin_pct' AS hidden, " + nums("revenue units_sold", 5) + " FROM mart")
_SIX = "CAST(({0}) * 1000000 AS HUGEINT)"
FACTS = {"sales": ["sale_date", "region", "product_id", "units_sold", *map(_SIX.format, ("list_price", "unit_cost", "discount_pct", "net_revenue")),
                   "inventory_units", "reorder_point", "CAST(source_loaded_at AS DATE)"],
         "marketing": ["activity_date", "region", "channel", _SIX.format("spend"), "impressions", "sessions", "orders", "new_customers",
                       "CAST(source_loaded_at AS DATE)"],
         "market_context": ["week_start", "region", *(f"CAST(round_even({c} * 1e6, 0) AS BIGINT)" for c in ("competitor_price_index", "weather_index")),
                            "event_type", "source_type", "CAST(source_loaded_at AS DATE)"],
         "customer_success": ["activity_date", "region", "active_customers", "churned_customers", "support_tickets",
                              "CAST(round_even(platform_uptime_pct * 1e6, 0) AS BIGINT)", "CAST(source_loaded_at AS DATE)"]}
add("stored_prints", prints(FACTS))
