"""SQL fragments that restate the test facts and operators for DuckDB.

They are written from the definitions, not generated from the Spark plans, so that a
mistake in one is not repeated in the other.
"""

from __future__ import annotations

import re

from causeway.sources.contracts import METRIC_SOURCE, load_contracts

CONTRACTS = load_contracts()

CTE: dict[str, str] = {}


def build(final: str) -> str:
    """Prefix a query with the fragments it needs, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTE:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTE[name])

    visit(final)
    if not needed:
        return final
    parts = [f"{name} AS MATERIALIZED ({CTE[name]})" for name in CTE if name in needed]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final


def values(rows: list[tuple], columns: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


CTE["placed"] = """
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate,
         CAST(o_orderdate AS DATE) AS day, r_name AS region
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

CTE["sales"] = """
  SELECT CAST(l_shipdate AS DATE) AS sale_date, region, p_brand AS product_id,
         SUM(CAST(l_quantity AS BIGINT)) AS units_sold,
         MAX(CAST(p_retailprice AS DECIMAL(12,2))) AS list_price,
         MIN(CAST(p_retailprice AS DECIMAL(12,2))) AS unit_cost,
         MAX(CAST(l_discount AS DECIMAL(5,4))) AS discount_pct,
         SUM(CAST(l_extendedprice AS DECIMAL(14,2)) * (CAST(1 AS DECIMAL(5,4)) - CAST(l_discount AS DECIMAL(5,4)))) AS net_revenue,
         SUM(CAST(p_size AS BIGINT)) AS inventory_units, 25 * COUNT(*) AS reorder_point,
         MAX(l_shipdate) AS source_loaded_at
  FROM lineitem JOIN placed ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3"""

CTE["first_orders"] = """
  SELECT day, region, o_orderpriority, COUNT(*) AS n FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM placed)
  WHERE rn = 1 GROUP BY 1, 2, 3"""

CTE["marketing"] = """
  SELECT p.day AS activity_date, p.region, p.o_orderpriority AS channel,
         SUM(CAST(o_totalprice AS DECIMAL(14,2))) * CAST(0.05 AS DECIMAL(3,2)) AS spend,
         20 * COUNT(*) AS impressions, SUM(1 + o_orderkey % 7) AS sessions, COUNT(*) AS orders,
         COALESCE(MAX(f.n), 0) AS new_customers, MAX(o_orderdate) AS source_loaded_at
  FROM placed p LEFT JOIN first_orders f
    ON f.day = p.day AND f.region = p.region AND f.o_orderpriority = p.o_orderpriority
  GROUP BY 1, 2, 3"""

CTE["market_context"] = """
  SELECT CAST(date_trunc('week', day) AS DATE) AS week_start, region,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / COUNT(*) / 250000.0 AS competitor_price_index,
         0.8 + AVG(CASE WHEN o_orderpriority = '5-LOW' THEN 1.0 ELSE 0.0 END) AS weather_index,
         CASE WHEN AVG(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) > 0.3
              THEN 'ambiguous_local_event' END AS event_type,
         'scheduled_feed' AS source_type, MAX(o_orderdate) AS source_loaded_at
  FROM placed GROUP BY 1, 2"""

CTE["customer_success"] = """
  SELECT day AS activity_date, region, COUNT(DISTINCT o_custkey) AS active_customers,
         COUNT(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS churned_customers,
         COUNT(*) FILTER (o_orderpriority = '1-URGENT') AS support_tickets,
         1.0 - 0.1 * COUNT(*) FILTER (o_orderstatus = 'P') / COUNT(*) AS platform_uptime_pct,
         MAX(o_orderdate) AS source_loaded_at
  FROM placed GROUP BY 1, 2"""

CTE["feed_days"] = """
  SELECT 'sales' AS source_name, sale_date AS health_date, region, COUNT(*) AS n, 3 AS expected, 24 AS cadence
  FROM sales GROUP BY sale_date, region
  UNION ALL SELECT 'marketing', activity_date, region, COUNT(*), 1, 24 FROM marketing GROUP BY activity_date, region
  UNION ALL SELECT 'customer_success', activity_date, region, active_customers, 1, 24 FROM customer_success
  UNION ALL SELECT 'market_context', week_start, region, 1, 1, 168 FROM market_context"""

CTE["source_health"] = """
  SELECT health_date, source_name, region, cadence AS expected_cadence_hours, lag_hours AS observed_lag_hours,
         completeness AS completeness_pct,
         CASE WHEN completeness < 50 OR lag_hours > 96 THEN 'stale' ELSE 'healthy' END AS status
  FROM (SELECT *, LEAST(100.0, 100.0 * n / expected) AS completeness,
          CAST(6 + COALESCE(GREATEST(24 * (health_date - LAG(health_date) OVER
            (PARTITION BY source_name, region ORDER BY health_date)) - cadence, 0), 0) AS DOUBLE) AS lag_hours
        FROM feed_days)"""

CTE["calendar"] = """
  SELECT day AS calendar_date, region, o_orderpriority AS event_name, COUNT(*) AS n FROM placed GROUP BY 1, 2, 3"""

CTE["spine"] = """
  SELECT sale_date AS metric_date, region FROM sales UNION SELECT activity_date, region FROM marketing
  UNION SELECT activity_date, region FROM customer_success"""

CTE["mart"] = """
  SELECT d.metric_date, d.region, s.* EXCLUDE (metric_date, region), m.* EXCLUDE (metric_date, region),
         c.competitor_price_index, c.weather_index, c.event_type, c.source_type AS context_source_type,
         CAST(x.active_customers AS DOUBLE) AS total_active_customers,
         CAST(x.churned_customers AS DOUBLE) AS churned_customers,
         CAST(x.support_tickets AS DOUBLE) AS support_ticket_volume, CAST(x.platform_uptime_pct AS DOUBLE) AS platform_uptime_pct,
         c.source_loaded_at AS context_freshness, x.source_loaded_at AS success_freshness
  FROM spine d
  LEFT JOIN (SELECT sale_date AS metric_date, region, CAST(SUM(net_revenue) AS DOUBLE) AS revenue,
               CAST(SUM(units_sold) AS DOUBLE) AS units_sold,
               CAST(SUM(net_revenue) AS DOUBLE) / NULLIF(CAST(SUM(units_sold) AS DOUBLE), 0) AS average_selling_price,
               AVG(CAST(discount_pct AS DOUBLE)) AS average_discount_pct,
               AVG(CASE WHEN inventory_units >= reorder_point THEN 1.0 ELSE 0.0 END) AS stock_availability,
               (CAST(SUM(net_revenue) AS DOUBLE) - CAST(SUM(units_sold * unit_cost) AS DOUBLE))
                 / NULLIF(CAST(SUM(net_revenue) AS DOUBLE), 0) AS margin_pct,
               MAX(source_loaded_at) AS sales_freshness
             FROM sales GROUP BY 1, 2) s ON s.metric_date = d.metric_date AND s.region = d.region
  LEFT JOIN (SELECT activity_date AS metric_date, region, CAST(SUM(spend) AS DOUBLE) AS marketing_spend,
               CAST(SUM(sessions) AS DOUBLE) AS sessions, CAST(SUM(orders) AS DOUBLE) AS orders,
               CAST(SUM(new_customers) AS DOUBLE) AS new_customers,
               CAST(SUM(orders) AS DOUBLE) / NULLIF(CAST(SUM(sessions) AS DOUBLE), 0) AS conversion_rate,
               CAST(SUM(spend) AS DOUBLE) / NULLIF(CAST(SUM(new_customers) AS DOUBLE), 0) AS customer_acquisition_cost,
               MAX(source_loaded_at) AS marketing_freshness
             FROM marketing GROUP BY 1, 2) m ON m.metric_date = d.metric_date AND m.region = d.region
  LEFT JOIN market_context c ON c.region = d.region AND c.week_start = CAST(date_trunc('week', d.metric_date) AS DATE)
  LEFT JOIN customer_success x ON x.activity_date = d.metric_date AND x.region = d.region"""

CTE["contract"] = values(
    [(c.kpi, c.operator, c.components[0][0], c.components[1][0] if len(c.components) > 1 else None, c.max_lag)
     for c in CONTRACTS.values()], "kpi, operator, component_a, component_b, context_days")

CTE["driver_list"] = values(
    [(c.kpi, d.explains, d.name, d.column, dict(c.components)[d.explains], i, d.max_lag, d.cadence, d.role, d.mediator,
      d.sign, c.max_lag) for c in CONTRACTS.values() for i, d in enumerate(c.drivers)],
    "kpi, component, driver, x_column, y_column, ordinal, max_lag, cadence, causal_role, mediates_through, "
    "expected_effect_sign, context_days")

CTE["component_list"] = values(
    [(c.kpi, n, col, i) for c in CONTRACTS.values() for i, (n, col) in enumerate(c.components)],
    "kpi, component, col, ordinal")

CTE["metric_source"] = values([(m, s) for s, ms in METRIC_SOURCE.items() for m in ms], "metric, source_name")

_METRICS = sorted({col for c in CONTRACTS.values() for _, col in c.components}
                  | {d.column for c in CONTRACTS.values() for d in c.drivers})

CTE["mart_long"] = " UNION ALL ".join(
    f"SELECT metric_date, region, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM mart" for m in _METRICS)

CTE["series"] = """
  SELECT c.kpi, a.region, a.metric_date,
         CASE c.operator WHEN 'multiply' THEN a.value * b.value WHEN 'divide' THEN a.value / NULLIF(b.value, 0)
              ELSE a.value END AS value
  FROM contract c JOIN mart_long a ON a.metric = c.component_a
  LEFT JOIN mart_long b ON b.metric = c.component_b AND b.region = a.region AND b.metric_date = a.metric_date"""

CTE["shifts"] = """
  SELECT kpi, region, metric_date, before_mean AS segment_mean_before, after_mean AS segment_mean_after,
         after_mean - before_mean AS shift_magnitude
  FROM (SELECT kpi, region, metric_date,
          AVG(value) OVER b AS before_mean, AVG(value) OVER a AS after_mean, COUNT(*) OVER b AS nb, COUNT(*) OVER a AS na
        FROM series WHERE value IS NOT NULL
        WINDOW b AS (PARTITION BY kpi, region ORDER BY metric_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
               a AS (PARTITION BY kpi, region ORDER BY metric_date ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
  WHERE nb = 10 AND na = 10"""

CTE["incidents"] = """
  SELECT kpi, region, metric_date AS window_start FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY kpi, region, year(metric_date)
      ORDER BY round(abs(shift_magnitude), 6) DESC, metric_date) AS rn FROM shifts) WHERE rn = 1"""

CTE["bounds"] = """
  SELECT kpi, region, window_start, window_start - 98 AS history_start, window_start - 8 AS history_end,
         window_start AS incident_start, window_start + 10 AS incident_end FROM incidents"""

CTE["component_days"] = """
  SELECT b.kpi, b.region, b.window_start, c.component, c.ordinal, m.metric_date, m.value,
         CASE WHEN m.metric_date <= b.history_end THEN 'history'
              WHEN m.metric_date >= b.window_start THEN 'incident' ELSE 'gap' END AS role
  FROM bounds b JOIN component_list c ON c.kpi = b.kpi
  JOIN mart_long m ON m.region = b.region AND m.metric = c.col
   AND m.metric_date BETWEEN b.history_start AND b.incident_end"""

CTE["levels"] = """
  SELECT d.*, COALESCE(h.level, 0.0) AS baseline, COALESCE(i.level, 0.0) AS incident
  FROM (SELECT kpi, region, window_start, component, ordinal,
          COUNT(*) FILTER (role = 'history') AS history_rows, COUNT(*) FILTER (role = 'incident') AS incident_rows
        FROM component_days GROUP BY ALL) d
  LEFT JOIN (SELECT kpi, region, window_start, component, AVG(value) AS level FROM (
      SELECT *, ROW_NUMBER() OVER w - 1 AS idx, COUNT(*) OVER (PARTITION BY kpi, region, window_start, component) AS n
      FROM component_days WHERE role = 'history' AND value IS NOT NULL
      WINDOW w AS (PARTITION BY kpi, region, window_start, component ORDER BY metric_date))
    WHERE idx >= n // 2 GROUP BY ALL) h USING (kpi, region, window_start, component)
  LEFT JOIN (SELECT kpi, region, window_start, component, AVG(value) AS level FROM (
      SELECT *, ROW_NUMBER() OVER w - 1 AS idx, COUNT(*) OVER (PARTITION BY kpi, region, window_start, component) AS n
      FROM component_days WHERE role = 'incident' AND value IS NOT NULL
      WINDOW w AS (PARTITION BY kpi, region, window_start, component ORDER BY metric_date))
    WHERE n = 1 OR idx >= n // 2 GROUP BY ALL) i USING (kpi, region, window_start, component)"""

CTE["sides"] = """
  SELECT c.operator AS decomposition_type, c.component_a, c.component_b, a.kpi, a.region, a.window_start,
         a.baseline AS a0, a.incident AS a1, b.baseline AS b0, b.incident AS b1
  FROM contract c JOIN levels a ON a.kpi = c.kpi AND a.ordinal = 0
  LEFT JOIN levels b ON b.kpi = a.kpi AND b.region = a.region AND b.window_start = a.window_start AND b.ordinal = 1
  WHERE a.history_rows > 0 AND a.incident_rows > 0"""


def decomposition(method: str = "shapley") -> str:
    if method == "shapley":
        ea = "((a1 - a0) / b0 + (a1 - a0) / b1) / 2"
        eb = "((a1 / b1 - a1 / b0) + (a0 / b1 - a0 / b0)) / 2"
    elif method == "forward":
        ea, eb = "(a1 - a0) / b0", "a1 / b1 - a1 / b0"
    else:
        ea = "((a1 - a0) / b0 + (a0 / b1 - a0 / b0)) / 2"
        eb = "((a1 / b1 - a1 / b0) + (a1 - a0) / b1) / 2"
    return f"""
  SELECT *, total_change - (effect_a + effect_b + interaction_effect) AS residual0,
         CASE WHEN unstable THEN 0.0 ELSE total_change - (effect_a + effect_b + interaction_effect) END AS residual,
         unstable OR (decomposition_type <> 'single' AND abs(total_change - (effect_a + effect_b + interaction_effect))
           > GREATEST(abs(total_change) * 0.01, 1e-9)) AS is_volatile
  FROM (SELECT *, abs(b0) < 1e-6 OR abs(b1) < 1e-6 AS bad,
    COALESCE(decomposition_type = 'divide' AND (abs(b0) < 1e-6 OR abs(b1) < 1e-6), FALSE) AS unstable,
    CASE decomposition_type WHEN 'multiply' THEN a1 * b1 - a0 * b0
      WHEN 'divide' THEN (CASE WHEN abs(b1) >= 1e-6 THEN a1 / b1 ELSE 0.0 END) - (CASE WHEN abs(b0) >= 1e-6 THEN a0 / b0 ELSE 0.0 END)
      ELSE a1 - a0 END AS total_change,
    CASE decomposition_type WHEN 'multiply' THEN (a1 - a0) * b0
      WHEN 'divide' THEN CASE WHEN abs(b0) < 1e-6 OR abs(b1) < 1e-6 THEN 0.0 ELSE {ea} END ELSE a1 - a0 END AS effect_a,
    CASE decomposition_type WHEN 'multiply' THEN (b1 - b0) * a0
      WHEN 'divide' THEN CASE WHEN abs(b0) < 1e-6 OR abs(b1) < 1e-6 THEN 0.0 ELSE {eb} END ELSE 0.0 END AS effect_b,
    CASE decomposition_type WHEN 'multiply' THEN (a1 - a0) * (b1 - b0) ELSE 0.0 END AS interaction_effect
  FROM sides)"""


CTE["decomposed"] = decomposition()

CTE["changes"] = """
  SELECT *, CASE WHEN abs(k0) > 1e-9 THEN total_change / k0 END AS percent_change,
         CASE WHEN abs(k0) > 1e-9 THEN abs(total_change / k0) > 0.02 ELSE abs(total_change) > 1e-9 END AS is_material
  FROM (SELECT *, CASE decomposition_type WHEN 'multiply' THEN a0 * b0 WHEN 'single' THEN a0
                    ELSE CASE WHEN abs(b0) >= 1e-9 THEN a0 / b0 END END AS k0 FROM decomposed)"""

CTE["impacts"] = """
  SELECT kpi, region, window_start, component_a AS component, 0 AS ordinal, effect_a AS impact, a0 AS baseline, a1 AS incident FROM decomposed
  UNION ALL SELECT kpi, region, window_start, component_b, 1, effect_b, b0, b1 FROM decomposed WHERE component_b IS NOT NULL"""
