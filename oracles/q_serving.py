"""Oracles for causeway.plans.q_serving."""

from __future__ import annotations

import re

import oracles.q_stage4  # noqa: F401  (defines the fragments used below)
from oracles.base import CTE, build
from oracles.q_mart import nums

ORACLES: dict[str, str] = {}


def add(name: str, final: str) -> None:
    ORACLES[name] = build(final)


K = "kpi, region, window_start"

# The action fragments once more, over the fused weights.
_AGAIN = ("relevant", "cand", "pick1", "pick2", "pick3", "action0", "action", "fsum", "calibrated")
for _name in _AGAIN:
    _text = CTE[_name]
    for _other in _AGAIN:
        _text = re.sub(rf"\b{_other}\b", f"f_{_other}", _text)
    if _name == "relevant":
        _text = re.sub(r"\bevidence\b", "fused", _text)
    CTE[f"f_{_name}"] = _text.replace("softmax_probability AS weight", "fused_probability AS weight")

CTE["last_packet"] = """
  SELECT p.* FROM packet p JOIN (SELECT kpi, region, MAX(window_start) AS w FROM packet GROUP BY ALL) m
    ON m.kpi = p.kpi AND m.region = p.region AND m.w = p.window_start"""
CTE["last_evidence"] = """
  SELECT e.* FROM evidence e JOIN (SELECT kpi, region, MAX(window_start) AS w FROM evidence GROUP BY ALL) m
    ON m.kpi = e.kpi AND m.region = e.region AND m.w = e.window_start"""
CTE["best_row"] = """
  SELECT kpi, region, driver FROM (SELECT e.kpi, e.region, e.driver, ROW_NUMBER() OVER (PARTITION BY e.kpi, e.region ORDER BY
      CASE WHEN e.driver = COALESCE(a.leading_explanation_driver, a.primary_driver) AND e.component = a.primary_component THEN 0
           WHEN e.driver = COALESCE(a.leading_explanation_driver, a.primary_driver) THEN 1 ELSE 2 END,
      round(e.softmax_probability, 9) DESC, e.ordinal) AS rn
    FROM last_evidence e LEFT JOIN action a ON a.kpi = e.kpi AND a.region = e.region AND a.window_start = e.window_start) WHERE rn = 1"""
FRIENDLY = "array_to_string(list_transform(string_split({c}, '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ')"
CTE["grid"] = "SELECT kpi, region FROM contract, (SELECT DISTINCT region FROM mart)"
CTE["cards"] = f"""
  SELECT g.kpi, g.region,
    CASE WHEN p.kpi IS NULL THEN CASE WHEN n.c > 0 THEN 'Analysis in progress' ELSE 'Stable — no structural incident' END
         WHEN confidence_level = 'Low' OR freshness_caveat IS NOT NULL THEN 'Needs validation' ELSE 'Investigation available' END AS card_status,
    CASE WHEN p.kpi IS NULL THEN CASE WHEN n.c > 0 THEN 'Shift detected' ELSE 'No incident' END
         WHEN percent_change IS NULL THEN 'Baseline near zero' ELSE printf('%+.1f%%', percent_change * 100) END AS change,
    CASE WHEN p.kpi IS NULL THEN CASE WHEN n.c > 0 THEN 'Pending' ELSE 'Not required' END ELSE confidence_level END AS confidence,
    COALESCE(CAST(p.window_start AS VARCHAR), '—') AS incident_date,
    CASE WHEN p.kpi IS NULL THEN '—' ELSE COALESCE({FRIENDLY.format(c='b.driver')}, '—') END AS top_driver
  FROM grid g LEFT JOIN last_packet p ON p.kpi = g.kpi AND p.region = g.region
  LEFT JOIN best_row b ON b.kpi = g.kpi AND b.region = g.region
  LEFT JOIN (SELECT kpi, region, COUNT(*) AS c FROM incidents GROUP BY ALL) n ON n.kpi = g.kpi AND n.region = g.region"""

add("coverage_matrix", """
  SELECT *, CASE WHEN decision_packets > 0 THEN 'ready' WHEN changepoints_detected > 0 THEN 'changepoint found, evidence not yet computed'
                 ELSE 'no changepoint detected' END AS status
  FROM (SELECT g.kpi, g.region,
          (SELECT COUNT(*) FROM incidents i WHERE i.kpi = g.kpi AND i.region = g.region) AS changepoints_detected,
          (SELECT COUNT(*) FROM packet i WHERE i.kpi = g.kpi AND i.region = g.region) AS decision_packets
        FROM grid g)""")
add("kpi_summary", "SELECT * FROM cards JOIN (SELECT DISTINCT kpi FROM contract) USING (kpi)".replace(
    "SELECT *", "SELECT kpi, region, card_status, change, confidence, incident_date, top_driver"))
add("dashboard_counters", """
  SELECT region, COUNT(*) FILTER (card_status IN ('Investigation available', 'Needs validation')) AS active,
         COUNT(*) FILTER (starts_with(card_status, 'Stable')) AS stable, COUNT(*) FILTER (confidence = 'Low') AS low_confidence,
         COUNT(*) FILTER (card_status = 'Analysis in progress') AS pending FROM cards GROUP BY 1""")
add("business_evidence", f"""
  SELECT {K}, {FRIENDLY.format(c='driver')} AS possible_driver, {FRIENDLY.format(c='component')} AS what_it_can_explain,
         CASE evidence_mode WHEN 'historical_relationship' THEN 'Historical pattern' WHEN 'structural_break' THEN 'New structural shift'
           ELSE 'Not enough evidence' END AS evidence_type,
         CASE WHEN cadence > 1 THEN (best_lag_days // cadence) || ' source period' || CASE WHEN best_lag_days = cadence THEN '' ELSE 's' END
           || ' (~' || best_lag_days || ' days; ' || cadence || '-day resolution)' ELSE best_lag_days || ' days' END AS historical_lead_time,
         is_significant AS statistical_check_passed,
         CASE model_status WHEN 'fitted' THEN 'Model fitted' WHEN 'insufficient_history' THEN 'Not enough history'
           ELSE 'No useful historical variation' END AS evidence_availability,
         {nums('typical_historical_level:5 incident_level:5 relative_evidence_weight_pct:4')}
  FROM (SELECT *, baseline_value AS typical_historical_level, incident_value AS incident_level,
               100 * softmax_probability AS relative_evidence_weight_pct FROM last_evidence)""")
add("weight_shift", f"""SELECT {K}, component, driver, {nums('probability_before:5 probability_after:5')} FROM (
  SELECT f.*, f.softmax_probability AS probability_before, f.fused_probability AS probability_after FROM fused f
  JOIN last_evidence l ON l.kpi = f.kpi AND l.region = f.region AND l.window_start = f.window_start AND l.component = f.component AND l.driver = f.driver)""")
add("latest_fused_weight", f"SELECT {K}, component, driver, {nums('fused_probability', 5)} FROM fused")
add("contract_enrichment", f"""SELECT e.kpi, region, window_start, e.component, e.driver, d.cadence AS source_cadence_days, d.causal_role,
  d.mediates_through, d.expected_effect_sign FROM evidence e JOIN driver_list d ON d.kpi = e.kpi AND d.component = e.component AND d.driver = e.driver""")
add("recent_telemetry", """SELECT event_id, event_type AS operation_name, CAST(floor(value * 10) AS BIGINT) AS latency_ms,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""")
_FRAMES = {"changepoints": "incidents", "decomposition": "decomposed", "driver_evidence": "evidence", "retrieved_context": "assess",
           "decision_packets": "packet", "evidence_bundle": "packet",
           "orchestrator_updates": "(SELECT f.kpi, f.region FROM fused f JOIN web_search w ON w.kpi = f.kpi AND w.region = f.region AND w.window_start = f.window_start)"}
add("artifact_counts", " UNION ALL ".join(
    f"SELECT kpi, region, COUNT(*) AS records, '{n}' AS artifact FROM {t} GROUP BY kpi, region" for n, t in _FRAMES.items()))
def _long(frame: str, table: str, item: str, fields: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{frame}' AS frame, {K}, {item} AS item, '{n}' AS field, CAST({c} AS DOUBLE) AS number FROM {table}"
                              for n, c in fields.items())


_UPDATED = _FRAMES["orchestrator_updates"].replace("SELECT f.kpi, f.region", "SELECT f.*")
add("dashboard_frames", f"SELECT frame, {K}, item, field, {nums('number', 4)} FROM (" + " UNION ALL ".join([
    _long("changepoints", "incidents", "''", {"found": "1"}),
    _long("decomposition", "decomposed", "''", {c: c for c in ("total_change", "effect_a", "effect_b", "interaction_effect")}),
    _long("driver_evidence", "evidence", "component || ':' || driver", {"evidence_score": "evidence_score", "weight": "softmax_probability"}),
    _long("retrieved_context", "assess", "source_index || ':' || hypothesis", {"support": "support", "confidence": "confidence"}),
    _long("decision_packets", "packet", "''", {"percent_change": "percent_change", "gap": "top_probability_gap"}),
    _long("orchestrator_updates", _UPDATED, "component || ':' || driver", {"before": "softmax_probability", "after": "fused_probability"}),
    f"SELECT 'evidence_bundle', {K}, '', 'drivers', CAST(COUNT(*) AS DOUBLE) FROM evidence GROUP BY ALL"]) + ")")
add("decision_cases", f"SELECT {K}, primary_driver, action_level FROM f_action WHERE primary_driver IS NOT NULL")
CARDS = f"""SELECT {K}, sample_count, {nums('adjustment adjusted_readiness_score')} FROM f_calibrated c
  WHERE window_start = (SELECT MAX(window_start) FROM f_calibrated x WHERE x.kpi = c.kpi AND x.region = c.region)"""
add("calibration_cards", CARDS)
add("refresh_feedback", CARDS)
add("stored_feedback_refresh", CARDS)
add("stored_feedback_changes", f"SELECT {K} FROM f_calibrated WHERE kpi = 'revenue' AND sample_count > 0")
add("stored_external_refresh", f"SELECT {K}, component, driver, {nums('fused_probability', 5)} FROM fused")
add("stored_wording_refresh", f"SELECT {K}, action_level, primary_driver, secondary_driver FROM f_action")
add("refresh_wording", f"SELECT {K}, action_level, primary_driver, secondary_driver FROM f_action")
add("refresh_external", f"SELECT {K}, component, driver, {nums('fused_probability', 5)} FROM fused")
add("bundle_round_trip", f"""
  SELECT a.kpi, a.region, a.window_start, a.action_level,
    (SELECT COUNT(*) FROM evidence e WHERE e.kpi = a.kpi AND e.region = a.region AND e.window_start = a.window_start) AS n_drivers,
    (SELECT COUNT(*) FROM impacts e WHERE e.kpi = a.kpi AND e.region = a.region AND e.window_start = a.window_start) AS n_components
  FROM f_action a""")
