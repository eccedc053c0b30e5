"""Oracles for causeway.plans.q_evidence."""

from __future__ import annotations

from oracles.base import CTE, build
from oracles.q_mart import nums

ORACLES: dict[str, str] = {}


def add(name: str, final: str) -> None:
    ORACLES[name] = build(final)


P = "kpi, region, window_start, component, driver"
G = "kpi, region, window_start, component"

CTE["pair_days"] = """
  SELECT b.kpi, b.region, b.window_start, d.component, d.driver, d.max_lag, d.cadence, d.context_days,
         d.causal_role, d.mediates_through, d.expected_effect_sign, d.ordinal, x.metric_date, x.value AS x, y.value AS y,
         CASE WHEN x.metric_date <= b.history_end THEN 'history'
              WHEN x.metric_date >= b.window_start THEN 'incident' ELSE 'gap' END AS role
  FROM bounds b JOIN driver_list d ON d.kpi = b.kpi
  JOIN mart_long x ON x.region = b.region AND x.metric = d.x_column AND x.metric_date BETWEEN b.history_start AND b.incident_end
  JOIN mart_long y ON y.region = b.region AND y.metric = d.y_column AND y.metric_date = x.metric_date"""

CTE["pair_periods"] = f"""
  SELECT {P}, cadence, max_lag,
         CASE WHEN cadence = 7 THEN CAST(date_trunc('week', metric_date) AS DATE) - DATE '1970-01-01'
              ELSE metric_date - DATE '1970-01-01' END AS period, AVG(x) AS x, AVG(y) AS y
  FROM pair_days WHERE role = 'history' GROUP BY ALL"""

CTE["lag_table"] = f"""
  WITH p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {P} ORDER BY period) AS idx FROM pair_periods),
  ks AS (SELECT UNNEST(range(0, 40)) AS k)
  SELECT {P}, k, k * cadence AS lag_days, COUNT(ox) AS overlap,
         CASE WHEN COUNT(ox) >= CASE WHEN cadence = 1 THEN 15 ELSE GREATEST(6, CAST(ceil(15.0 / cadence) AS INTEGER)) END
               AND MIN(ox) < MAX(ox) AND MIN(oy) < MAX(oy) THEN corr(ox, oy) END AS correlation
  FROM (SELECT b.kpi, b.region, b.window_start, b.component, b.driver, b.cadence, ks.k,
          CASE WHEN a.x IS NOT NULL AND b.y IS NOT NULL THEN a.x END AS ox,
          CASE WHEN a.x IS NOT NULL AND b.y IS NOT NULL THEN b.y END AS oy
        FROM p b JOIN ks ON ks.k <= ceil(CAST(b.max_lag AS DOUBLE) / b.cadence)
        LEFT JOIN p a ON a.kpi = b.kpi AND a.region = b.region AND a.window_start = b.window_start
          AND a.component = b.component AND a.driver = b.driver AND a.idx = b.idx - ks.k)
  GROUP BY {P}, k, cadence"""

CTE["lag_fold"] = f"""
  SELECT {P}, -1 AS k, CAST(-1 AS DOUBLE) AS best, CAST(0 AS DOUBLE) AS r, 0 AS lag_days, CAST(0 AS BIGINT) AS overlap FROM lag_table WHERE k = 0
  UNION ALL
  SELECT f.kpi, f.region, f.window_start, f.component, f.driver, t.k,
         CASE WHEN COALESCE(abs(t.correlation) > f.best + 0.02, FALSE) THEN abs(t.correlation) ELSE f.best END,
         CASE WHEN COALESCE(abs(t.correlation) > f.best + 0.02, FALSE) THEN t.correlation ELSE f.r END,
         CASE WHEN COALESCE(abs(t.correlation) > f.best + 0.02, FALSE) THEN CAST(t.lag_days AS INTEGER) ELSE f.lag_days END,
         CASE WHEN COALESCE(abs(t.correlation) > f.best + 0.02, FALSE) THEN t.overlap ELSE f.overlap END
  FROM lag_fold f JOIN lag_table t ON t.kpi = f.kpi AND t.region = f.region AND t.window_start = f.window_start
   AND t.component = f.component AND t.driver = f.driver AND t.k = f.k + 1"""

CTE["lag_choice"] = f"""
  SELECT {P}, lag_days AS best_lag_days, r AS historical_lag_correlation, overlap
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {P} ORDER BY k DESC) AS rn FROM lag_fold) WHERE rn = 1"""

CTE["hist_stats"] = f"""
  SELECT {P}, AVG(x) AS mean_x, stddev_pop(x) AS std_x, median(x) AS med_x, COUNT(x) AS n_x, COUNT(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_pairs,
         AVG(CASE WHEN rx <= 30 THEN x END) AS tail_x, AVG(CASE WHEN ry <= 30 THEN y END) AS tail_y
  FROM (SELECT *, CASE WHEN x IS NOT NULL THEN ROW_NUMBER() OVER (PARTITION BY {P}, x IS NULL ORDER BY metric_date DESC) END AS rx,
               CASE WHEN y IS NOT NULL THEN ROW_NUMBER() OVER (PARTITION BY {P}, y IS NULL ORDER BY metric_date DESC) END AS ry
        FROM pair_days WHERE role = 'history') GROUP BY ALL"""

CTE["hist_mad"] = f"""
  SELECT {P}, median(abs(x - med_x)) AS mad_x FROM pair_days JOIN hist_stats USING ({P}) WHERE role = 'history' GROUP BY ALL"""

CTE["moved"] = f"""
  SELECT {P}, COUNT(m.x) AS aligned_rows, AVG(m.x) AS level_x FROM lag_choice
  JOIN (SELECT {P}, metric_date FROM pair_days WHERE role = 'incident') t USING ({P})
  LEFT JOIN (SELECT {P}, metric_date AS d, x FROM pair_days WHERE metric_date >= window_start - context_days) m USING ({P})
  WHERE m.d = t.metric_date - best_lag_days GROUP BY ALL"""

CTE["comp_now"] = f"SELECT {P}, AVG(y) AS level_y FROM pair_days WHERE role = 'incident' GROUP BY ALL"

CTE["sig0"] = f"""
  SELECT a.*, b.best_lag_days, b.historical_lag_correlation, b.overlap, COALESCE(s.n_x, 0) AS n_x, COALESCE(s.n_pairs, 0) AS n_pairs,
         COALESCE(s.tail_x, 0.0) AS baseline_value, COALESCE(s.tail_y, 0.0) AS component_baseline,
         COALESCE(m.level_x, 0.0) AS incident_value, COALESCE(m.aligned_rows, 0) AS aligned_rows,
         COALESCE(c.level_y, 0.0) AS component_incident, COALESCE(s.std_x, 0.0) AS history_std,
         CASE WHEN s.mean_x IS NULL OR m.level_x IS NULL THEN 0.0
              WHEN mad_x >= 1e-9 THEN (m.level_x - s.med_x) / (mad_x / 0.6745)
              WHEN s.std_x >= 1e-9 THEN (m.level_x - s.mean_x) / s.std_x ELSE 0.0 END AS zscore,
         CASE WHEN s.mean_x IS NULL OR m.level_x IS NULL OR abs(m.level_x - s.mean_x) < 1e-9 THEN 0.0
              ELSE abs(m.level_x - s.mean_x) / (abs(m.level_x) + abs(s.mean_x) + 1e-9) END AS shift_score,
         CASE WHEN a.causal_role = 'upstream' AND EXISTS (SELECT 1 FROM driver_list q WHERE q.kpi = a.kpi
               AND q.component = a.component AND q.driver = a.mediates_through) THEN 0.6 ELSE 1.0 END AS mechanism_weight
  FROM (SELECT DISTINCT {P}, ordinal, causal_role, mediates_through, expected_effect_sign, cadence FROM pair_days) a
  JOIN lag_choice b USING ({P}) LEFT JOIN hist_stats s USING ({P}) LEFT JOIN hist_mad USING ({P})
  LEFT JOIN moved m USING ({P}) LEFT JOIN comp_now c USING ({P})"""

MOVE = ("CASE WHEN abs({b} - {a}) <= 1e-6 * GREATEST(abs({a}), abs({b}), 1.0) THEN 0 WHEN {b} > {a} THEN 1 ELSE -1 END")
CTE["sig"] = f"""
  SELECT *, CASE WHEN dm = 0 OR cm = 0 OR effect = 0 THEN 'not_evaluated' WHEN dm * effect = cm THEN 'aligned'
              ELSE 'contradictory' END AS direction
  FROM (SELECT *, LEAST(1.0, abs(zscore) / 3.0) AS severity,
          n_x > 0 AND history_std < 1e-9 AND shift_score > 1e-9 AS is_break,
          {MOVE.format(a='baseline_value', b='incident_value')} AS dm,
          {MOVE.format(a='component_baseline', b='component_incident')} AS cm,
          CASE expected_effect_sign WHEN 'positive' THEN 1 WHEN 'negative' THEN -1
            ELSE CASE WHEN historical_lag_correlation >= 1e-9 THEN 1 WHEN historical_lag_correlation <= -1e-9 THEN -1 ELSE 0 END END AS effect
        FROM sig0)"""

CTE["gate_day"] = f"""
  SELECT {G}, metric_date, y IS NOT NULL AND LAG(x, CAST(best_lag_days AS INTEGER)) OVER (PARTITION BY {P} ORDER BY metric_date) IS NOT NULL AS complete
  FROM pair_days JOIN lag_choice USING ({P}) WHERE role = 'history'"""
CTE["gate_size"] = f"SELECT {G}, COUNT(*) AS n_drivers FROM sig GROUP BY {G}"
CTE["gate_seen"] = f"""
  SELECT {G}, COUNT(*) AS observed FROM (
    SELECT {G}, n_drivers, metric_date FROM gate_day JOIN gate_size USING ({G}) GROUP BY ALL HAVING COUNT(*) FILTER (complete) = n_drivers) GROUP BY {G}"""
CTE["gate"] = f"""
  SELECT *, GREATEST(30, 10 * n_drivers) AS required,
         CASE WHEN observed >= GREATEST(30, 10 * n_drivers) THEN 'fitted' ELSE 'insufficient_history' END AS fit
  FROM (SELECT {G}, COALESCE(observed, 0) AS observed, n_drivers FROM gate_size LEFT JOIN gate_seen USING ({G}))"""

CTE["ev0"] = f"""
  SELECT *, CASE WHEN is_break THEN 'structural_break' WHEN fit = 'fitted' THEN 'historical_relationship'
              ELSE 'insufficient_evidence' END AS evidence_mode,
         CASE WHEN is_break THEN 'historical_variance_unavailable' ELSE fit END AS model_status,
         CASE WHEN is_break THEN 0.0 ELSE zscore END AS driver_zscore,
         CASE WHEN is_break THEN shift_score ELSE 0.0 END AS structural_break_score,
         NOT is_break AND fit = 'fitted' AND abs(historical_lag_correlation) >= 0.3 AS is_significant,
         CASE WHEN is_break OR fit = 'fitted' THEN direction ELSE 'not_evaluated' END AS direction_consistency,
         CASE WHEN NOT is_break AND fit = 'fitted' THEN historical_lag_correlation ELSE 0.0 END AS historical_coefficient,
         CASE WHEN is_break THEN shift_score * CASE WHEN direction = 'contradictory' THEN 0.1 ELSE 1.0 END * mechanism_weight
              WHEN fit = 'fitted' THEN LEAST(1.0, abs(historical_lag_correlation)) * severity
                * CASE WHEN abs(historical_lag_correlation) >= 0.3 THEN 1.0 ELSE 0.5 END
                * CASE WHEN direction = 'contradictory' THEN 0.1 ELSE 1.0 END * mechanism_weight
              ELSE 0.0 END AS evidence_score
  FROM sig JOIN gate USING ({G})"""

CTE["evidence"] = f"""
  SELECT *, ex / SUM(ex) OVER (PARTITION BY {G}) AS softmax_probability
  FROM (SELECT *, exp(normalized_score / 0.35 - MAX(normalized_score / 0.35) OVER (PARTITION BY {G})) AS ex
        FROM (SELECT *, CASE WHEN MAX(evidence_score) OVER (PARTITION BY {G}) > 0
                THEN GREATEST(evidence_score, 0.0) / MAX(evidence_score) OVER (PARTITION BY {G}) ELSE 0.0 END AS normalized_score
              FROM ev0))"""

add("coarse_period_means", f"SELECT {P}, period, {nums('x y', 5)} FROM pair_periods WHERE cadence > 1")
add("lag_corr", f"SELECT {P}, lag_days, overlap, {nums('correlation')} FROM lag_table")
add("lag_best", f"SELECT {P}, best_lag_days, overlap, {nums('historical_lag_correlation')} FROM lag_choice")
add("trailing_baseline", f"SELECT {P}, {nums('baseline_value component_baseline', 5)} FROM sig")
add("lag_aligned_incident", f"SELECT {P}, aligned_rows, {nums('incident_value component_incident', 5)} FROM sig")
add("robust_zscore", f"SELECT {P}, {nums('zscore severity', 5)} FROM sig")
add("structural_break", f"SELECT {P}, is_break, {nums('shift_score history_std', 5)} FROM sig")
add("direction_consistency", f"SELECT {P}, direction FROM sig")
add("mediator_weight", f"SELECT {P}, causal_role, {nums('mechanism_weight')} FROM sig")
add("model_sufficiency", f"SELECT {G}, observed, n_drivers, required, fit AS model_status FROM gate")
add("usable_series", f"""SELECT {P}, COUNT(x) AS n_observed, COUNT(x) >= 12 AND COALESCE(stddev_pop(x), 0) > 1e-8 AS is_usable
  FROM pair_days WHERE role = 'history' GROUP BY {P}""")
add("evidence_scores", f"SELECT {P}, evidence_mode, model_status, direction_consistency, is_significant, "
    + nums("driver_zscore structural_break_score evidence_score", 5) + " FROM evidence")
add("evidence_weights", f"SELECT {P}, {nums('normalized_score softmax_probability', 5)} FROM evidence")
