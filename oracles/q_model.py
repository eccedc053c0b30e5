"""Oracles for causeway.plans.q_model."""

from __future__ import annotations

import re

from oracles.base import CONTRACTS, CTE, build, values
from oracles.q_mart import nums

ORACLES: dict[str, str] = {}


def add(name: str, final: str) -> None:
    ORACLES[name] = build(final)


# Best segmentation of every series, restated as a table of grid ends: no end and no start is pruned.
CTE["cp_gap"] = values([(c.kpi, c.max_lag + 7) for c in CONTRACTS.values()], "kpi, gap")
CTE["cp_row"] = """
  SELECT kpi, region, metric_date, value, ROW_NUMBER() OVER (PARTITION BY kpi, region ORDER BY metric_date) AS i
  FROM series WHERE value IS NOT NULL AND region IN (SELECT region FROM mart GROUP BY 1 HAVING COUNT(DISTINCT metric_date) >= 60)"""
CTE["cp_stat"] = """
  SELECT kpi, region, COUNT(*) AS n, AVG(value) AS m, stddev_pop(value) AS sd FROM cp_row GROUP BY 1, 2 HAVING COUNT(*) >= 30 AND stddev_pop(value) > 1e-8"""
CTE["cp_z"] = """
  SELECT r.kpi, r.region, r.i, s.n, SUM((value - m) / sd) OVER w AS s1, SUM(((value - m) / sd) * ((value - m) / sd)) OVER w AS s2
  FROM cp_row r JOIN cp_stat s ON s.kpi = r.kpi AND s.region = r.region
  WINDOW w AS (PARTITION BY r.kpi, r.region ORDER BY i)"""
CTE["cp_sum"] = """
  SELECT kpi, region, n, list_prepend(0.0, list(s1 ORDER BY i)) AS s1, list_prepend(0.0, list(s2 ORDER BY i)) AS s2,
         3.0 * ln(n) * (MAX(CASE WHEN i = n THEN s2 END) / n - (MAX(CASE WHEN i = n THEN s1 END) / n) ** 2) AS pen
  FROM cp_z GROUP BY kpi, region, n"""
CTE["cp_best"] = """
  SELECT kpi, region, 0 AS e, CAST([0.0] AS DOUBLE[]) AS f, CAST([0] AS INTEGER[]) AS p FROM cp_sum
  UNION ALL
  SELECT kpi, region, t, CASE WHEN t % 5 = 0 THEN list_append(f, best.c) ELSE f END, list_append(p, best.s)
  FROM (SELECT b.kpi, b.region, b.f, b.p, x.t, list_min(list_transform(list_filter(range(0, x.t - 9, 5), lambda s: f[s // 5 + 1] < 1e300), lambda s:
          {'c': f[s // 5 + 1] + (s2[x.t + 1] - s2[s + 1]) - (s1[x.t + 1] - s1[s + 1]) ** 2 / (x.t - s) + pen, 's': s})) AS pick
        FROM cp_best b JOIN cp_sum USING (kpi, region), LATERAL (SELECT CAST(CASE WHEN b.e + 5 < n THEN b.e + 5 ELSE n END AS INTEGER) AS t) x
        WHERE b.e < n) y, LATERAL (SELECT COALESCE(pick.c, 1e308) AS c, COALESCE(CAST(pick.s AS INTEGER), -1) AS s) best"""
CTE["cp_last"] = "SELECT kpi, region, n, p FROM cp_best JOIN cp_sum USING (kpi, region) WHERE e = n"
CTE["cp_cut"] = """
  SELECT kpi, region, n, p, p[len(p)] AS cut FROM cp_last
  UNION ALL SELECT kpi, region, n, p, p[cut // 5 + 1] FROM cp_cut WHERE cut > 0"""
CTE["cp_found"] = """
  SELECT *, ROW_NUMBER() OVER (PARTITION BY kpi, region ORDER BY abs(after - before) DESC, cut) AS pos FROM (
    SELECT c.kpi, c.region, c.cut, (SELECT AVG(value) FROM cp_row r WHERE r.kpi = c.kpi AND r.region = c.region AND r.i BETWEEN c.cut - 9 AND c.cut) AS before,
           (SELECT AVG(value) FROM cp_row r WHERE r.kpi = c.kpi AND r.region = c.region AND r.i BETWEEN c.cut + 1 AND c.cut + 10) AS after
    FROM cp_cut c WHERE c.cut BETWEEN 10 AND c.n - 10)"""
CTE["cp_keep"] = """
  SELECT kpi, region, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS kept FROM cp_stat
  UNION ALL
  SELECT k.kpi, k.region, f.pos, CASE WHEN len(list_filter(k.kept, lambda x: abs(x - f.cut) < g.gap)) = 0 THEN list_append(k.kept, f.cut) ELSE k.kept END
  FROM cp_keep k JOIN cp_found f ON f.kpi = k.kpi AND f.region = k.region AND f.pos = k.pos + 1 JOIN cp_gap g ON g.kpi = k.kpi"""
CTE["cp"] = """
  SELECT f.kpi, f.region, r.metric_date AS changepoint_date, f.before AS segment_mean_before, f.after AS segment_mean_after, f.after - f.before AS shift_magnitude
  FROM cp_found f JOIN cp_row r ON r.kpi = f.kpi AND r.region = f.region AND r.i = f.cut + 1
  JOIN (SELECT kpi, region, max_by(kept, pos) AS kept FROM cp_keep GROUP BY 1, 2) k ON k.kpi = f.kpi AND k.region = f.region
  WHERE list_contains(k.kept, f.cut)"""

add("changepoints", "SELECT kpi, region, changepoint_date, 'pelt_l2' AS method, " + nums("segment_mean_before segment_mean_after shift_magnitude", 4) + " FROM cp")


def detected(final: str) -> str:
    """A query over the fragments with the detected changepoints in place of the yearly largest shifts."""
    text = {**CTE, "incidents": "SELECT kpi, region, changepoint_date AS window_start FROM cp"}
    order: list[str] = []

    def visit(sql: str, above: tuple[str, ...]) -> None:
        for name in text:
            if name not in order and name not in above and re.search(rf"\b{name}\b", sql):
                visit(text[name], (*above, name))
                order.append(name)
    visit(final, ())
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({text[n]})" for n in order) + "\n" + final


K = "kpi, region, window_start"
add("detected_recall", """SELECT COUNT(*) FILTER (hit) AS hits, COUNT(*) AS total, round(COUNT(*) FILTER (hit) / COUNT(*) + 3.3e-8, 6) AS recall FROM (
  SELECT t.scenario_id, bool_or(COALESCE(abs(c.changepoint_date - t.changepoint_date) <= 2, FALSE)) AS hit
  FROM truth t LEFT JOIN cp c ON c.kpi = t.kpi AND c.region = t.region GROUP BY 1)""")
ORACLES["detected_decomposition"] = detected(
    f"SELECT {K}, decomposition_type, is_material, is_volatile, {nums('total_change:4 effect_a:4 effect_b:4 interaction_effect:4 percent_change:5')} FROM changes")
ORACLES["detected_health"] = detected(f"SELECT {K}, observed_sources, missing_sources, stale_sources, healthy, health_status, freshness_gap_days FROM verdict")
ORACLES["stored_run"] = ORACLES["detected_decomposition"]
add("stored_telemetry", "SELECT unnest(['detect changepoints', 'decompose', 'score drivers', 'decide']) AS operation_name, 'success' AS status, 1 AS n FROM (SELECT COUNT(*) FROM region)")
add("stored_changes", """
  SELECT kpi, region, window_start AS changepoint_date, CASE WHEN region = 'ASIA' THEN 'third' WHEN kpi = 'revenue' THEN 'second' ELSE 'first' END AS method
  FROM incidents WHERE region <> 'EUROPE'
  UNION ALL SELECT kpi, region, window_start, 'log' FROM incidents WHERE region = 'AFRICA'""")
_CSV = """(SELECT o_orderkey, o_orderkey % 11 = 0 AS bad_day, o_orderkey % 13 = 0 AS bad_units, CAST(o_orderdate AS DATE) AS day, o_orderstatus,
  CASE WHEN o_orderkey % 17 = 0 THEN 'NaN' WHEN o_orderkey % 19 = 0 THEN ' ' ELSE CAST(o_orderkey % 1000 AS VARCHAR) END AS units FROM orders)"""
ORACLES["csv_loaded"] = f"""SELECT o_orderkey, TRY_CAST(NULLIF(NULLIF(units, 'NaN'), ' ') AS BIGINT) AS units, day AS calendar_date
  FROM {_CSV} WHERE NOT bad_day AND NOT bad_units"""
ORACLES["csv_rejects"] = f"""SELECT 'business_calendar' AS table_name,
  concat_ws(',', o_orderkey, CASE WHEN bad_day THEN '1999-02-30' ELSE CAST(day AS VARCHAR) END, CASE WHEN bad_units THEN 'n/a' ELSE units END, o_orderstatus) AS line,
  concat_ws('; ', CASE WHEN bad_units THEN 'units: ''n/a'' is no int' END, CASE WHEN bad_day THEN 'calendar_date: ''1999-02-30'' is no date' END) AS reason
  FROM {_CSV} WHERE bad_day OR bad_units"""
add("bound_read", "SELECT kpi, region, window_start AS changepoint_date FROM incidents WHERE kpi = 'revenue' AND window_start >= DATE '1995-01-01'")
