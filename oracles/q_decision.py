"""Oracles for causeway.plans.q_decision."""

from __future__ import annotations

from causeway.sources.contracts import driver_names, load_playbook
from oracles.base import CONTRACTS, CTE, build, values
from oracles.q_mart import nums

ORACLES: dict[str, str] = {}


def add(name: str, final: str) -> None:
    ORACLES[name] = build(final)


K = "kpi, region, window_start"

CTE["required"] = f"""
  SELECT DISTINCT i.kpi, i.region, i.window_start, m.source_name FROM incidents i
  JOIN (SELECT kpi, kpi AS metric FROM contract UNION SELECT kpi, driver FROM driver_list) d ON d.kpi = i.kpi
  JOIN metric_source m ON m.metric = d.metric"""

CTE["as_of"] = f"""
  SELECT r.*, h.health_date, h.status, h.observed_lag_hours, h.completeness_pct
  FROM (SELECT r.*, (SELECT MAX(health_date) FROM source_health x WHERE x.region = r.region
          AND x.source_name = r.source_name AND x.health_date <= r.window_start) AS d FROM required r) r
  LEFT JOIN source_health h ON h.region = r.region AND h.source_name = r.source_name AND h.health_date = r.d"""

CTE["verdict"] = f"""
  SELECT *, CASE WHEN n_seen > 0 AND stale_sources = '' THEN TRUE ELSE FALSE END AS healthy,
         CASE WHEN n_seen = 0 THEN 'source_health_unavailable' WHEN stale_sources = '' THEN 'healthy_sources'
              ELSE 'stale_or_incomplete_source' END AS health_status,
         CASE WHEN n_seen = 0 THEN 4 ELSE CAST(ceil(max_lag / 24.0) AS BIGINT) END AS freshness_gap_days
  FROM (SELECT {K}, COUNT(health_date) AS n_seen, COALESCE(MAX(observed_lag_hours), 0) AS max_lag,
          COALESCE(string_agg(source_name, ',' ORDER BY source_name) FILTER (health_date IS NOT NULL), '') AS observed_sources,
          COALESCE(string_agg(source_name, ',' ORDER BY source_name) FILTER (health_date IS NULL), '') AS missing_sources,
          CASE WHEN COUNT(health_date) = 0 THEN '' ELSE COALESCE(string_agg(source_name, ',' ORDER BY source_name) FILTER (
            health_date IS NULL OR lower(trim(status)) NOT IN ('healthy', 'ok', 'fresh') OR observed_lag_hours > 72
            OR completeness_pct < 95), '') END AS stale_sources
        FROM as_of GROUP BY ALL)"""

CTE["comp_rank"] = f"""
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY round(abs(COALESCE(impact, 0)), 9) DESC, ordinal) AS component_rank
  FROM impacts"""

CTE["lead"] = f"SELECT {K}, component AS dominant, baseline AS dom_base, incident AS dom_now FROM comp_rank WHERE component_rank = 1"

CTE["relevant"] = f"""
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY round(softmax_probability, 9) DESC, ordinal) AS rn,
         evidence_mode = 'structural_break' OR is_significant AS ok,
         evidence_mode <> 'insufficient_evidence' AND NOT starts_with(model_status, 'insufficient') AS usable
  FROM (SELECT e.*, l.dominant, l.dom_base, l.dom_now, bool_or(e.component = l.dominant) OVER (PARTITION BY {K}) AS anymatch
        FROM evidence e JOIN lead l USING ({K})) WHERE component = dominant OR NOT anymatch"""

CTE["top"] = f"""
  SELECT {K}, MAX(CASE WHEN anymatch THEN dominant END) AS evidence_component,
         COALESCE(MAX(CASE WHEN rn = 1 THEN softmax_probability END), 0.0) + COALESCE(MAX(CASE WHEN rn = 2 THEN softmax_probability END), 0.0) AS top2_probability_mass,
         COALESCE(MAX(CASE WHEN rn = 1 THEN softmax_probability END), 0.0) - COALESCE(MAX(CASE WHEN rn = 2 THEN softmax_probability END), 0.0) AS top_probability_gap,
         bool_or(ok) AS any_driver_significant, bool_or(usable) AS model_sufficient, bool_or(rn = 1 AND ok) AS top_ok
  FROM relevant GROUP BY ALL"""

CTE["packet"] = f"""
  SELECT *, CASE WHEN decision_type = 'monitor' OR NOT model_sufficient OR NOT healthy OR freshness_gap_days > 3 THEN 'Low'
              ELSE CASE CAST(top2_probability_mass < 0.55 AS INTEGER) + CAST(top_probability_gap < 0.10 AS INTEGER) + CAST(NOT top_ok AS INTEGER)
                WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END END AS confidence_level,
         CASE WHEN stale_sources <> '' THEN 'Faulty or late feeds behind this result: ' || replace(stale_sources, ',', ', ') || '. Confidence is therefore low.'
              WHEN freshness_gap_days > 3 THEN 'The data behind this result is ' || freshness_gap_days || ' days old.' END AS freshness_caveat
  FROM (SELECT c.*, t.* EXCLUDE ({K}), v.* EXCLUDE ({K}), CASE WHEN c.is_material THEN 'investigate' ELSE 'monitor' END AS decision_type
        FROM changes c JOIN top t USING ({K}) JOIN verdict v USING ({K}))"""

MOVE = """CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'unknown'
  WHEN abs({a}) > 1e-12 AND abs(({b} - {a}) / {a}) < 0.02 THEN 'unchanged'
  WHEN abs({a}) <= 1e-12 AND abs({b} - {a}) < 1e-12 THEN 'unchanged'
  WHEN {b} > {a} THEN 'increased' ELSE 'decreased' END"""

CTE["cand"] = f"""
  SELECT *, usable AND move IN ('increased', 'decreased') AND align <> 'contradictory' AS ready,
         ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY round(weight, 9) DESC, ordinal) AS pos
  FROM (SELECT *, softmax_probability AS weight, direction_consistency AS align,
          {MOVE.format(a='baseline_value', b='incident_value')} AS move FROM relevant WHERE component = dominant)"""

CTE["pick1"] = f"""
  SELECT {K}, MIN(CASE WHEN usable THEN pos END) AS explain_pos, MIN(CASE WHEN ready THEN pos END) AS ready_pos,
         COUNT(*) AS n_all, COUNT(*) FILTER (usable) AS n_usable FROM cand GROUP BY ALL"""

CTE["pick2"] = f"""
  SELECT p.*, COALESCE(m.pos, p.ready_pos) AS chosen_pos FROM pick1 p
  LEFT JOIN cand c ON c.kpi = p.kpi AND c.region = p.region AND c.window_start = p.window_start AND c.pos = p.ready_pos
  LEFT JOIN cand m ON m.kpi = p.kpi AND m.region = p.region AND m.window_start = p.window_start
    AND c.causal_role = 'upstream' AND m.driver = c.mediates_through AND m.ready"""

CTE["pick3"] = f"""
  SELECT p.*, (SELECT MIN(pos) FROM cand c WHERE c.kpi = p.kpi AND c.region = p.region AND c.window_start = p.window_start
                AND c.ready AND c.pos <> p.chosen_pos) AS second_pos,
         (SELECT MIN(u.pos) FROM cand u, cand s WHERE u.kpi = p.kpi AND u.region = p.region AND u.window_start = p.window_start
            AND s.kpi = p.kpi AND s.region = p.region AND s.window_start = p.window_start AND s.pos = p.chosen_pos
            AND u.usable AND u.causal_role = 'upstream' AND u.mediates_through = s.driver) AS upstream_pos
  FROM pick2 p"""

CTE["owners"] = values(
    [(n, (load_playbook()["playbooks"].get(n) or {}).get("owner", "Business owner")) for n in driver_names(CONTRACTS)],
    "driver, owner")

CTE["action0"] = f"""
  SELECT k.*, l.dominant, {MOVE.format(a='l.dom_base', b='l.dom_now')} AS comp_move, p.n_all, p.n_usable, p.chosen_pos,
         e.driver AS e_driver, e.move AS e_move, s.driver AS s_driver, s.move AS s_move, s.align AS s_align,
         z.driver AS z_driver, u.driver AS u_driver, eo.owner AS e_owner, so.owner AS s_owner,
         CASE WHEN NOT k.healthy THEN 'data_quality_first' WHEN k.decision_type <> 'investigate' THEN 'monitor'
              WHEN COALESCE(p.n_usable, 0) = 0 THEN 'nothing' WHEN p.chosen_pos IS NULL THEN 'validate_unexplained' ELSE 'moved' END AS c,
         COALESCE(k.confidence_level = 'Low' OR (s.evidence_mode = 'historical_relationship' AND NOT s.is_significant)
           OR COALESCE(s.weight - z.weight <= 0.10 + 1e-12, FALSE) OR k.is_volatile, FALSE) AS amb
  FROM packet k JOIN lead l USING ({K}) LEFT JOIN pick3 p USING ({K})
  LEFT JOIN cand e ON e.kpi = k.kpi AND e.region = k.region AND e.window_start = k.window_start AND e.pos = p.explain_pos
  LEFT JOIN cand s ON s.kpi = k.kpi AND s.region = k.region AND s.window_start = k.window_start AND s.pos = p.chosen_pos
  LEFT JOIN cand z ON z.kpi = k.kpi AND z.region = k.region AND z.window_start = k.window_start AND z.pos = p.second_pos
  LEFT JOIN cand u ON u.kpi = k.kpi AND u.region = k.region AND u.window_start = k.window_start AND u.pos = p.upstream_pos
  LEFT JOIN owners eo ON eo.driver = e.driver LEFT JOIN owners so ON so.driver = s.driver"""

CTE["action"] = f"""
  SELECT {K}, healthy, confidence_level, top_probability_gap, any_driver_significant, decision_type, percent_change, total_change,
    CASE c WHEN 'nothing' THEN 'validate' WHEN 'moved' THEN CASE WHEN amb THEN 'validate' ELSE 'act' END ELSE c END AS action_level,
    CASE c WHEN 'validate_unexplained' THEN e_driver WHEN 'moved' THEN s_driver END AS primary_driver,
    CASE WHEN c IN ('nothing', 'validate_unexplained', 'moved') THEN dominant END AS primary_component,
    CASE c WHEN 'validate_unexplained' THEN e_move WHEN 'moved' THEN s_move END AS driver_direction,
    CASE WHEN c IN ('validate_unexplained', 'moved') THEN comp_move END AS component_direction,
    CASE WHEN c = 'moved' THEN z_driver END AS secondary_driver,
    CASE c WHEN 'monitor' THEN FALSE WHEN 'moved' THEN amb ELSE TRUE END AS is_ambiguous,
    CASE c WHEN 'data_quality_first' THEN 'data_quality_blocked' WHEN 'monitor' THEN 'monitor' WHEN 'nothing' THEN 'no_usable_driver'
      WHEN 'validate_unexplained' THEN 'no_material_driver_movement' ELSE 'material_movement' END AS movement_status,
    CASE WHEN c = 'moved' THEN s_align ELSE 'not_evaluated' END AS direction_alignment,
    CASE WHEN c = 'nothing' THEN CASE WHEN COALESCE(n_all, 0) = 0 THEN 'driver_coverage_gap' ELSE 'insufficient_history' END END AS validation_reason,
    CASE WHEN c IN ('validate_unexplained', 'moved') THEN e_driver END AS leading_explanation_driver,
    CASE WHEN c = 'moved' THEN u_driver END AS upstream_driver,
    CASE c WHEN 'data_quality_first' THEN 'Data / Analytics Engineering' WHEN 'validate_unexplained' THEN e_owner WHEN 'moved' THEN s_owner END AS owner,
    CASE WHEN c = 'data_quality_first' THEN 'Low' ELSE confidence_level END AS evidence_confidence,
    CASE c WHEN 'data_quality_first' THEN 'Fix data first' WHEN 'monitor' THEN 'Monitor' WHEN 'nothing' THEN 'Validate first'
      WHEN 'validate_unexplained' THEN 'Investigate evidence gap'
      ELSE CASE WHEN amb THEN 'Validate first' ELSE 'Act after operational confirmation' END END AS action_readiness
  FROM action0"""

add("source_dependencies", f"SELECT {K}, source_name FROM required")
add("source_health_asof", f"SELECT {K}, source_name, health_date, status, {nums('observed_lag_hours completeness_pct')} FROM as_of")
add("missing_sources", f"SELECT {K}, source_name FROM as_of WHERE health_date IS NULL")
add("source_health_verdict", f"SELECT {K}, observed_sources, missing_sources, stale_sources, healthy, health_status, freshness_gap_days FROM verdict")
add("component_rank", f"SELECT {K}, component, component_rank FROM comp_rank")
add("driver_rank", f"""SELECT {K}, component, driver, ROW_NUMBER() OVER (PARTITION BY {K}, component
  ORDER BY round(softmax_probability, 9) DESC, ordinal) AS driver_rank FROM evidence""")
add("top2_gap", f"SELECT {K}, evidence_component, any_driver_significant, {nums('top2_probability_mass top_probability_gap', 5)} FROM packet")
add("confidence_label", f"SELECT {K}, decision_type, confidence_level FROM packet")
add("decision_packet", f"SELECT {K}, decision_type, confidence_level, healthy, freshness_caveat, {nums('percent_change', 5)} FROM packet")
add("direction_class", f"SELECT {K}, component, driver, {MOVE.format(a='baseline_value', b='incident_value')} AS move FROM evidence")
add("action_context", f"""SELECT {K}, action_level, primary_driver, primary_component, driver_direction, component_direction,
  secondary_driver, is_ambiguous, movement_status, direction_alignment, validation_reason, leading_explanation_driver,
  upstream_driver, owner, evidence_confidence, action_readiness FROM action""")

READY = """CASE action_level WHEN 'act' THEN 0.85 WHEN 'validate' THEN 0.6 WHEN 'validate_unexplained' THEN 0.45
  WHEN 'monitor' THEN 0.35 WHEN 'data_quality_first' THEN 0.2 ELSE 0.5 END"""
add("base_readiness", f"SELECT {K}, action_level, {nums('base_readiness_score')} FROM (SELECT *, {READY} AS base_readiness_score FROM action)")

_PATTERNS = [(c.kpi, d.name, level) for c in CONTRACTS.values() for d in c.drivers
             for level in ("act", "validate", "validate_unexplained")]
CTE["pattern"] = values([(i, *p) for i, p in enumerate(_PATTERNS)], "slot, kpi, primary_driver, action_level")
CTE["feedback"] = f"""
  SELECT e.ts AS created_at, r_name AS region, p.kpi, p.primary_driver, p.action_level, user_id % 7 = 0 AS is_demo,
         CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 1.0 WHEN 'signup' THEN 0.0 WHEN 'error' THEN -1.0 END AS v
  FROM events e JOIN region ON r_regionkey = user_id % 5 JOIN pattern p ON p.slot = event_id % {len(_PATTERNS)}"""
add("feedback_dispositions", """SELECT COUNT(v) AS n, 'accepted' AS status FROM feedback
  UNION ALL SELECT COUNT(*) - COUNT(v), 'rejected' FROM feedback""")
CTE["fsum"] = f"""
  SELECT a.kpi, a.region, a.window_start, a.action_level, a.primary_driver, COUNT(f.kpi) AS n_rows, COUNT(f.v) AS sample_count,
         COUNT(f.v) FILTER (f.region = a.region) AS same_region_count,
         CAST(COALESCE(SUM(CASE WHEN f.v IS NULL THEN 0.0 WHEN f.region = a.region THEN 1.0 ELSE 0.5 END), 0) AS DOUBLE) AS w,
         CAST(COALESCE(SUM(f.v * CASE WHEN f.region = a.region THEN 1.0 ELSE 0.5 END), 0) AS DOUBLE) AS s
  FROM action a LEFT JOIN feedback f ON f.kpi = a.kpi AND f.primary_driver = a.primary_driver AND f.action_level = a.action_level
   AND NOT f.is_demo AND f.created_at < TIMESTAMP '2024-01-20 00:00:00' GROUP BY ALL"""
CTE["calibrated"] = f"""
  SELECT *, w AS effective_sample_size, sample_count > 0 AS applied, round(CASE WHEN w > 0 THEN s / w ELSE 0.0 END, 6) AS weighted_mean,
         round(CASE WHEN w > 0 THEN w / (w + 5.0) ELSE 0.0 END, 6) AS reliability,
         round(CASE WHEN w > 0 THEN 0.1 * (s / w) * (w / (w + 5.0)) ELSE 0.0 END, 6) AS adjustment, {READY} AS base_readiness_score,
         {READY} + round(CASE WHEN w > 0 THEN 0.1 * (s / w) * (w / (w + 5.0)) ELSE 0.0 END, 6) AS adjusted_readiness_score,
         CASE WHEN primary_driver IS NULL THEN 'Without a leading driver there is no pattern to look ratings up by.'
              WHEN sample_count > 0 THEN 'Earlier ratings of this pattern move the readiness figure within its bound.'
              WHEN n_rows > 0 THEN 'Ratings of this pattern exist, but none holds a known verdict.'
              ELSE 'Nobody has rated this pattern before the cut-off.' END AS reason FROM fsum"""
add("feedback_calibration", f"SELECT {K}, applied, sample_count, same_region_count, reason, "
    + nums("effective_sample_size weighted_mean reliability adjustment base_readiness_score adjusted_readiness_score")
    + " FROM calibrated")
