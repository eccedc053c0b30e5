"""The contract rules restated over the contracts that the parts stand for."""

from __future__ import annotations

from oracles.base import CTE, build

ORACLES: dict[str, str] = {}

CTE["c_part"] = """
  SELECT p_brand || '/' || (p_partkey // 50) AS kpi, 'c' || (p_partkey % 4) AS component, 'd' || (p_partkey % 7) AS driver, p_partkey AS ordinal,
         p_size - 4 AS max_lag, p_size % 11 AS cadence, p_partkey // 50 % 4 AS kind, p_size % 3 = 0 AS is_component,
         CASE p_size % 5 WHEN 0 THEN 'Direct ' WHEN 1 THEN 'upstream' WHEN 2 THEN 'context' WHEN 3 THEN 'response' ELSE 'leader' END AS causal_role,
         CASE p_partkey % 6 WHEN 0 THEN 'up' WHEN 1 THEN 'positive' WHEN 2 THEN 'negative' ELSE 'unknown' END AS expected_effect_sign,
         CASE WHEN p_partkey % 3 = 0 THEN 'd' || (p_size % 9) ELSE '' END AS mediator
  FROM part"""
CTE["c_kpi"] = """SELECT DISTINCT kpi, kind, CASE kind WHEN 0 THEN 'k = a * b' WHEN 1 THEN 'k = a / b' WHEN 2 THEN 'k' ELSE 'k = a * b / c' END AS formula FROM c_part"""
CTE["c_component"] = "SELECT kpi, component FROM c_part WHERE is_component"
CTE["c_driver"] = "SELECT * FROM c_part WHERE NOT is_component"
CTE["c_home"] = "SELECT kpi, driver AS mediator, arg_max(component, ordinal) AS home FROM c_driver GROUP BY 1, 2"
ORACLES["contract_violations"] = build("""
  SELECT kpi, rule, subject, COUNT(*) AS n FROM (
    SELECT kpi, 'no components' AS rule, CAST(NULL AS VARCHAR) AS subject FROM c_kpi WHERE kpi NOT IN (SELECT kpi FROM c_component)
    UNION ALL SELECT kpi, 'formula mixes signs', formula FROM c_kpi WHERE kind = 3
    UNION ALL SELECT kpi, 'formula needs two components', CASE kind WHEN 0 THEN 'multiply' ELSE 'divide' END FROM c_kpi k
      WHERE kind < 2 AND (SELECT COUNT(*) FROM c_component c WHERE c.kpi = k.kpi) <> 2
    UNION ALL SELECT kpi, 'component declared twice', component FROM c_component GROUP BY kpi, component HAVING COUNT(*) > 1
    UNION ALL SELECT kpi, 'max_lag below 0', driver FROM c_driver WHERE max_lag < 0
    UNION ALL SELECT kpi, 'cadence below 1', driver FROM c_driver WHERE cadence < 1
    UNION ALL SELECT kpi, 'unknown role', driver FROM c_driver WHERE causal_role = 'leader'
    UNION ALL SELECT kpi, 'unknown sign', driver FROM c_driver WHERE expected_effect_sign = 'up'
    UNION ALL SELECT kpi, 'undeclared component', driver || ' > ' || component FROM c_driver d
      WHERE NOT EXISTS (SELECT 1 FROM c_component c WHERE c.kpi = d.kpi AND c.component = d.component)
    UNION ALL SELECT kpi, 'driver declared twice', driver || ' > ' || component FROM c_driver GROUP BY kpi, driver, component HAVING COUNT(*) > 1
    UNION ALL SELECT kpi, CASE WHEN home IS NULL THEN 'unknown mediator' ELSE 'mediator explains another component' END, driver || ' > ' || mediator
      FROM c_driver LEFT JOIN c_home USING (kpi, mediator) WHERE mediator <> '' AND (home IS NULL OR home <> component))
  GROUP BY ALL""")
