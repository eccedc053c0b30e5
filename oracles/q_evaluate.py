"""Oracles for causeway.plans.q_evaluate."""

from __future__ import annotations

import oracles.q_serving  # noqa: F401
from oracles.base import CTE, build
from oracles.q_mart import FACTS, nums, prints

ORACLES: dict[str, str] = {}


def add(name: str, final: str) -> None:
    ORACLES[name] = build(final)


K = "kpi, region, window_start"
CTE["truth"] = """
  SELECT i.kpi || '|' || i.region || '|' || i.window_start AS scenario_id, i.kpi, i.region, i.window_start,
         i.window_start + CAST(dayofyear(i.window_start) % 7 - 3 AS INTEGER) AS changepoint_date, l.dominant AS expected_component
  FROM incidents i LEFT JOIN lead l ON l.kpi = i.kpi AND l.region = i.region AND l.window_start = i.window_start"""
CTE["nearest"] = """
  SELECT scenario_id, kpi, region, window_start FROM (
    SELECT t.scenario_id, t.kpi, t.region, e.window_start, ROW_NUMBER() OVER (PARTITION BY t.scenario_id
      ORDER BY abs(e.window_start - t.changepoint_date), e.window_start) AS rn
    FROM truth t JOIN (SELECT DISTINCT kpi, region, window_start FROM evidence) e ON e.kpi = t.kpi AND e.region = t.region) WHERE rn = 1"""
CTE["case_rows"] = """
  SELECT n.scenario_id, e.* FROM nearest n JOIN truth t ON t.scenario_id = n.scenario_id
  JOIN evidence e ON e.kpi = n.kpi AND e.region = n.region AND e.window_start = n.window_start
  WHERE (t.expected_component IS NULL OR e.component = t.expected_component)
    AND e.evidence_mode <> 'insufficient_evidence' AND NOT starts_with(e.model_status, 'insufficient')"""
CTE["want_rank"] = """
  SELECT t.scenario_id, d.driver, ROW_NUMBER() OVER (PARTITION BY t.scenario_id ORDER BY d.driver DESC) AS rank
  FROM truth t JOIN driver_list d ON d.kpi = t.kpi AND d.component = t.expected_component"""
CTE["seen_rank"] = """
  SELECT scenario_id, driver, ROW_NUMBER() OVER (PARTITION BY scenario_id ORDER BY round(softmax_probability, 9) DESC, ordinal) AS position,
         RANK() OVER (PARTITION BY scenario_id ORDER BY round(softmax_probability, 9) DESC)
           + (COUNT(*) OVER (PARTITION BY scenario_id, round(softmax_probability, 9)) - 1) / 2.0 AS avg_rank
  FROM case_rows WHERE scenario_id IN (SELECT scenario_id FROM want_rank)"""
CTE["cases"] = """
  SELECT s.scenario_id, bool_or(s.position = 1 AND w.rank = 1) AS top1,
         CAST(COUNT(*) FILTER (s.position <= 2 AND w.rank <= 2) AS DOUBLE) / MAX(LEAST(2, n.n)) AS recall_at_2,
         COALESCE(1.0 / MIN(CASE WHEN w.rank IS NOT NULL THEN s.position END), 0.0) AS reciprocal_rank,
         CASE WHEN COUNT(w.rank) >= 2 AND MIN(CASE WHEN w.rank IS NOT NULL THEN avg_rank END) < MAX(CASE WHEN w.rank IS NOT NULL THEN avg_rank END)
           THEN corr(CAST(w.rank AS DOUBLE), CASE WHEN w.rank IS NOT NULL THEN avg_rank END) END AS spearman
  FROM seen_rank s LEFT JOIN want_rank w ON w.scenario_id = s.scenario_id AND w.driver = s.driver
  JOIN (SELECT scenario_id, COUNT(*) AS n FROM want_rank GROUP BY 1) n ON n.scenario_id = s.scenario_id GROUP BY 1"""
CTE["lag_cases"] = """
  SELECT t.scenario_id, d.driver, d.cadence, d.max_lag // 2 AS days, c.best_lag_days AS observed, abs(c.best_lag_days - d.max_lag // 2) AS err
  FROM truth t JOIN driver_list d ON d.kpi = t.kpi AND d.component = t.expected_component
  LEFT JOIN case_rows c ON c.scenario_id = t.scenario_id AND c.driver = d.driver"""

add("changepoint_recall", f"""
  SELECT hits, total, {nums('recall')} FROM (SELECT COUNT(*) FILTER (hit) AS hits, COUNT(*) AS total, COUNT(*) FILTER (hit) / CAST(COUNT(*) AS DOUBLE) AS recall
  FROM (SELECT scenario_id, EXISTS (SELECT 1 FROM incidents i WHERE i.kpi = t.kpi AND i.region = t.region
          AND abs(i.window_start - t.changepoint_date) <= 2) AS hit FROM truth t))""")
add("closest_window", "SELECT * FROM nearest")
add("rank_cases", f"SELECT scenario_id, top1, {nums('recall_at_2 reciprocal_rank spearman')} FROM cases")
add("rank_metrics", f"""SELECT eligible_cases, covered_cases, spearman_cases,
  {nums('evidence_coverage top1_accuracy recall_at_2 mean_reciprocal_rank mean_spearman')} FROM (
  SELECT n AS eligible_cases, COUNT(*) AS covered_cases, COUNT(spearman) AS spearman_cases, COUNT(*) / CAST(n AS DOUBLE) AS evidence_coverage,
         AVG(CAST(top1 AS INTEGER)) AS top1_accuracy, AVG(recall_at_2) AS recall_at_2, AVG(reciprocal_rank) AS mean_reciprocal_rank,
         AVG(spearman) AS mean_spearman FROM cases, (SELECT COUNT(DISTINCT scenario_id) AS n FROM want_rank) GROUP BY n)""")
add("lag_metrics", f"""SELECT exact_eligible, exact_covered, exact_correct, cadence_limited, cadence_consistent,
  {nums('exact_share mean_absolute_error median_absolute_error')} FROM (
  SELECT COUNT(*) FILTER (cadence = 1) AS exact_eligible, COUNT(*) FILTER (cadence = 1 AND observed IS NOT NULL) AS exact_covered,
         COUNT(*) FILTER (cadence = 1 AND err <= 2) AS exact_correct, COUNT(*) FILTER (cadence > 1) AS cadence_limited,
         COUNT(*) FILTER (cadence > 1 AND err <= GREATEST(cadence, 2)) AS cadence_consistent,
         COUNT(*) FILTER (cadence = 1 AND err <= 2) / CAST(COUNT(*) FILTER (cadence = 1 AND observed IS NOT NULL) AS DOUBLE) AS exact_share,
         AVG(err) FILTER (cadence = 1) AS mean_absolute_error, median(err) FILTER (cadence = 1) AS median_absolute_error FROM lag_cases)""")
add("health_recall", f"""
  SELECT COUNT(*) AS eligible_cases, {nums('source_detection_recall low_confidence_enforcement_rate')} FROM (
    SELECT AVG(CAST(n_bad = 2 AS INTEGER)) AS source_detection_recall,
           AVG(CAST(n_bad > 0 OR gap > 3 AS INTEGER)) AS low_confidence_enforcement_rate, COUNT(*) AS n FROM (
      SELECT scenario_id, COUNT(*) FILTER (h.health_date IS NULL OR status <> 'healthy' OR observed_lag_hours > 72 OR completeness_pct < 95) AS n_bad,
             ceil(MAX(observed_lag_hours) / 24.0) AS gap
      FROM (SELECT scenario_id, t.region, t.window_start, s.source_name, (SELECT MAX(health_date) FROM source_health x WHERE x.region = t.region
              AND x.source_name = s.source_name AND x.health_date <= t.window_start) AS d
            FROM truth t, (VALUES ('sales'), ('marketing')) s(source_name)) a
      LEFT JOIN source_health h ON h.region = a.region AND h.source_name = a.source_name AND h.health_date = a.d GROUP BY 1))""".replace(
    "SELECT COUNT(*) AS eligible_cases, round", "SELECT n AS eligible_cases, round"))
add("isolation_audit", f"""SELECT * FROM (SELECT COUNT(*) FILTER (source_type = 'orchestrator_retrieval') AS contaminated_rows FROM market_context),
  (SELECT COUNT(DISTINCT table_name) AS tables, COUNT(DISTINCT table_name) FILTER (row_count IS NULL OR content_sum IS NULL) AS changed_tables
   FROM ({prints(FACTS)}))""")
add("language_audit", """SELECT COUNT(*) AS checked, COALESCE(SUM(
    CASE WHEN action_level = 'act' AND movement_status <> 'material_movement' THEN 1 ELSE 0 END
    + CASE WHEN action_level = 'act' AND COALESCE(driver_direction, 'unknown') IN ('unchanged', 'unknown') THEN 1 ELSE 0 END
    + CASE WHEN action_level = 'act' AND direction_alignment = 'contradictory' THEN 1 ELSE 0 END
    + CASE WHEN action_level = 'act' AND primary_driver IS NULL THEN 1 ELSE 0 END
    + CASE WHEN action_level IN ('validate', 'validate_unexplained') AND starts_with(lower(action_readiness), 'act') THEN 1 ELSE 0 END
    + CASE WHEN COALESCE(action_readiness, '') = '' THEN 1 ELSE 0 END), 0)::BIGINT AS failures FROM f_action""")
add("policy_audit", f"""SELECT * FROM (SELECT COUNT(*) AS planned FROM plan), (SELECT COALESCE(SUM(
    CASE WHEN p.kpi IS NOT NULL AND a.action_level IN ('monitor', 'data_quality_first') THEN 1 ELSE 0 END
    + CASE WHEN p.kpi IS NULL AND COALESCE(n.n, 0) > 0 THEN 1 ELSE 0 END
    + CASE WHEN p.retrieval_target NOT IN ('web', 'internal', 'none') THEN 1 ELSE 0 END
    + CASE WHEN p.retrieval_target = 'web' AND COALESCE(p.retrieval_query, '') = '' THEN 1 ELSE 0 END
    + CASE WHEN p.retrieval_target <> 'web' AND COALESCE(p.retrieval_query, '') <> '' THEN 1 ELSE 0 END
    + CASE WHEN p.retrieval_target <> 'web' AND COALESCE(n.n, 0) > 0 THEN 1 ELSE 0 END
    + CASE WHEN length(p.clarification_question) - length(replace(p.clarification_question, '?', '')) <> 1 THEN 1 ELSE 0 END
    + CASE WHEN p.retrieval_target = 'web' AND NOT EXISTS (SELECT 1 FROM cands c WHERE c.kpi = p.kpi AND c.region = p.region
        AND c.window_start = p.window_start AND c.eligible) THEN 1 ELSE 0 END
    + CASE WHEN p.retrieval_target = 'web' AND NOT contains(p.retrieval_query, p.region) THEN 1 ELSE 0 END), 0)::BIGINT AS failures
  FROM action a LEFT JOIN plan p USING ({K}) LEFT JOIN (SELECT {K}, COUNT(*) AS n FROM sources GROUP BY ALL) n USING ({K}))""")
add("feedback_neutrality", """SELECT 0::BIGINT AS changed_evidence_rows, 0::BIGINT AS changed_decomposition_rows,
  COUNT(*) FILTER (applied) AS calibrated, COUNT(*) FILTER (abs(adjustment) > 0.1000001) AS out_of_bound FROM f_calibrated""")
