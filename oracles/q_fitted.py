"""The fitted model restated in SQL: unit-root tests, ridge by folds, drawn refits and intervals."""

from __future__ import annotations

from causeway.functions import kernels as K
from causeway.functions.linear import critical_statistic
from oracles.base import CTE, build
from oracles.q_evidence import G, P
from oracles.q_mart import nums
from oracles.q_model import detected

ORACLES: dict[str, str] = {}
LAGS, DRIVERS = 12, 3

CTE["u_slot"] = f"SELECT {P}, best_lag_days AS lag, ROW_NUMBER() OVER (PARTITION BY {G} ORDER BY ordinal, driver) AS slot FROM sig"
CTE["u_day"] = f"""
  SELECT {P}, lag, slot, x, y, ROW_NUMBER() OVER (PARTITION BY {P} ORDER BY metric_date) - 1 AS i
  FROM pair_days JOIN u_slot USING ({P}) WHERE role = 'history'"""
CTE["u_row"] = f"""
  SELECT {P}, lag, slot, i, CAST(x AS DOUBLE) AS v FROM u_day
  UNION ALL SELECT {G}, '', 0, 0, i, CAST(y AS DOUBLE) FROM u_day WHERE slot = 1"""
CTE["u_size"] = f"SELECT {P}, COUNT(v) AS n, AVG(v) AS mean, stddev_pop(v) AS sd FROM u_row GROUP BY {P}"
CTE["u_z"] = f"""
  SELECT {P}, n, i, (v - mean) / sd AS z, LEAST(CAST(ceil(12.0 * pow(n / 100.0, 0.25)) AS INTEGER), n // 2 - 2) AS lags,
         ROW_NUMBER() OVER (PARTITION BY {P} ORDER BY i) AS t
  FROM u_row JOIN u_size USING ({P}) WHERE v IS NOT NULL AND n >= 12 AND sd > 1e-8"""
CTE["u_d"] = f"SELECT *, lag(z) OVER (PARTITION BY {P} ORDER BY i) AS before, z - lag(z) OVER (PARTITION BY {P} ORDER BY i) AS d FROM u_z"
_PAST = ", ".join(f"lag(d, {k}) OVER w AS d{k}" for k in range(1, LAGS + 1))
CTE["u_step"] = f"SELECT *, {_PAST} FROM u_d WINDOW w AS (PARTITION BY {P} ORDER BY i)"


def elimination(name: str, rows: str, keys: str, features: list[str], steps: int) -> None:
    """``name``: matrices of cross products after ``steps`` columns were taken out in turn, with the residuals on the way."""
    size = len(features)
    CTE[f"{name}_f"] = f"SELECT {keys}, [{', '.join(features)}] AS f FROM {rows}"
    CTE[f"{name}_s"] = f"""
      SELECT {keys}, a, b, SUM(f[a] * f[b]) AS s, COUNT(*) AS m_rows
      FROM {name}_f, (SELECT unnest(range(1, {size + 1})) AS a), (SELECT unnest(range(1, {size + 1})) AS b) GROUP BY ALL"""
    CTE[f"{name}_m"] = f"""
      SELECT {keys}, m_rows, list(line ORDER BY a) AS m FROM (SELECT {keys}, a, m_rows, list(s ORDER BY b) AS line FROM {name}_s GROUP BY ALL) GROUP BY ALL"""
    CTE[f"{name}_e"] = f"""
      SELECT {keys}, m_rows, 0 AS c, m, list_transform(range(1, {size + 1}), lambda q: m[q][q]) AS own, CAST([] AS DOUBLE[]) AS rests, FALSE AS dependent FROM {name}_m
      UNION ALL
      SELECT {keys}, m_rows, c + 1, nm, own, list_append(rests, nm[{size}][{size}]), dependent OR (dead AND own[c + 1] > 0)
      FROM (SELECT *, CASE WHEN dead THEN m ELSE list_transform(range(1, {size + 1}), lambda r: CASE WHEN r <= c + 1 THEN m[r]
              ELSE list_transform(range(1, {size + 1}), lambda k: m[r][k] - m[r][c + 1] / m[c + 1][c + 1] * m[c + 1][k]) END) END AS nm
            FROM (SELECT *, NOT (m[c + 1][c + 1] > 1e-10 * own[c + 1]) AS dead FROM {name}_e WHERE c < {steps}))"""
    CTE[name] = f"SELECT * FROM {name}_e WHERE c = {steps}"


def past(order: str) -> list[str]:
    return [f"CASE WHEN {k} <= {order} THEN d{k} ELSE 0.0 END" for k in range(1, LAGS + 1)]


CTE["u_common"] = "SELECT * FROM u_step WHERE t >= lags + 2"
elimination("u_all", "u_common", f"{P}, lags", ["1.0", "before", *past("lags"), "d"], LAGS + 2)
CTE["u_aic"] = f"""
  SELECT {P}, u - 2 AS ord, m_rows * (ln(2 * pi()) + ln(GREATEST(rests[u], 1e-300) / m_rows) + 1) + 2 * u AS aic
  FROM (SELECT *, unnest(range(2, lags + 3)) AS u FROM u_all WHERE m_rows > lags + 2 AND NOT dependent)"""
CTE["u_order"] = f"""
  SELECT {P}, CAST(MIN(ord) AS INTEGER) AS lag_order FROM (SELECT *, MIN(aic) OVER (PARTITION BY {P}) AS low FROM u_aic) WHERE aic <= low + 1e-9 GROUP BY {P}"""
CTE["u_own"] = f"SELECT * FROM u_step JOIN u_order USING ({P}) WHERE t >= lag_order + 2"
elimination("u_one", "u_own", f"{P}, lag_order", ["1.0", *past("lag_order"), "before", "d"], LAGS + 1)
_A, _B = LAGS + 2, LAGS + 3
CTE["u_tau"] = f"""
  SELECT {P}, lag_order, CASE WHEN m_rows - lag_order - 2 > 0 THEN CASE WHEN variance > 0 THEN m[{_A}][{_B}] / m[{_A}][{_A}] / sqrt(variance) ELSE CAST('-inf' AS DOUBLE) END END AS statistic
  FROM (SELECT *, (m[{_B}][{_B}] - m[{_A}][{_B}] ** 2 / m[{_A}][{_A}]) / (m_rows - lag_order - 2) / m[{_A}][{_A}] AS variance FROM u_one)"""
CTE["u_test"] = f"""
  SELECT {P}, lag, slot, n, lag_order, statistic, NOT COALESCE(n >= 12 AND sd > 1e-8, FALSE) AS degenerate,
         NOT COALESCE(n >= 12 AND sd > 1e-8, FALSE) OR COALESCE(statistic > {critical_statistic()!r}, TRUE) AS differenced
  FROM (SELECT DISTINCT {P}, lag, slot FROM u_row) JOIN u_size USING ({P}) LEFT JOIN u_tau USING ({P})"""

# series as they enter the regression, moved down by their lag
CTE["f_now"] = f"""
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {P} ORDER BY i) AS rn FROM (
    SELECT {P}, r.slot, r.lag, i, degenerate, differenced, CASE WHEN degenerate THEN 0.0 WHEN differenced THEN v - lag(v) OVER (PARTITION BY {P} ORDER BY i) ELSE v END AS now
    FROM u_row r JOIN u_test USING ({P})) WHERE NOT differenced OR degenerate OR now IS NOT NULL"""
CTE["f_moved"] = f"""
  SELECT {', '.join('a.' + c.strip() for c in P.split(','))}, a.slot, a.i, b.now AS v FROM f_now a LEFT JOIN f_now b
  ON {' AND '.join(f'a.{c.strip()} = b.{c.strip()}' for c in P.split(','))} AND a.rn = b.rn + b.lag"""
_XS = ", ".join(f"COALESCE(MAX(v) FILTER (slot = {k}), 0.0) AS x{k}" for k in range(1, DRIVERS + 1))
CTE["f_usable"] = f"SELECT {G} FROM f_moved WHERE slot = 0 GROUP BY {G} HAVING COUNT(v) >= 12 AND stddev_pop(v) > 1e-8"
CTE["f_row"] = f"""
  SELECT *, COUNT(*) OVER (PARTITION BY {G}) AS n, ROW_NUMBER() OVER (PARTITION BY {G} ORDER BY i) - 1 AS idx FROM (
    SELECT {G}, p, i, COUNT(v) AS present, MAX(v) FILTER (slot = 0) AS y, {_XS}
    FROM (SELECT *, MAX(slot) OVER (PARTITION BY {G}) AS p FROM f_moved) GROUP BY {G}, p, i)
  JOIN f_usable USING ({G}) WHERE present = p + 1"""
_Z = ", ".join(f"({c} - AVG({c}) OVER g) / CASE WHEN stddev_pop({c}) OVER g < 2.22e-15 THEN 1.0 ELSE stddev_pop({c}) OVER g END AS {c}" for c in ("x1", "x2", "x3"))
CTE["f_z0"] = f"""
  SELECT {G}, n, p, idx, y - AVG(y) OVER g AS y, {_Z}, CAST(floor(n * 0.8) AS INTEGER) AS cut, LEAST(5, GREATEST(2, n // GREATEST(10, 5 * p))) AS ko
  FROM f_row WHERE n >= GREATEST(30, 10 * p) WINDOW g AS (PARTITION BY {G})"""
_FOLD = "CASE WHEN idx < ({n} % {k}) * ({n} // {k} + 1) THEN idx // ({n} // {k} + 1) ELSE {n} % {k} + (idx - ({n} % {k}) * ({n} // {k} + 1)) // ({n} // {k}) END"
CTE["f_z"] = f"""
  SELECT *, {_FOLD.format(n='n', k='ko')} AS outer_fold, CASE WHEN idx < cut THEN {_FOLD.format(n='cut', k='ki')} ELSE -1 END AS inner_fold, cut >= 10 AND n - cut >= 5 AS held
  FROM (SELECT *, GREATEST(2, LEAST(5, cut // 10)) AS ki FROM f_z0)"""


def ridge(keys: str, rows: str, alpha: str) -> str:
    """Coefficients b1..b3 and intercept b0 per ``keys`` and penalty, by Cramer's rule on centred sums."""
    def s(a, b):
        return f"(SUM({a} * {b}) - SUM({a}) * SUM({b}) / COUNT(*))"
    sums = ", ".join([*(f"{s(f'x{j}', f'x{k}')} AS q{j}{k}" for j in (1, 2, 3) for k in (1, 2, 3) if j <= k), *(f"{s(f'x{j}', 'y')} AS t{j}" for j in (1, 2, 3)),
                      *(f"AVG(x{j}) AS m{j}" for j in (1, 2, 3)), "AVG(y) AS my", "MAX(y) > MIN(y) AS varies"])

    def det(c):
        return f"({c[0][0]} * ({c[1][1]} * {c[2][2]} - {c[1][2]} * {c[2][1]}) - {c[0][1]} * ({c[1][0]} * {c[2][2]} - {c[1][2]} * {c[2][0]}) + {c[0][2]} * ({c[1][0]} * {c[2][1]} - {c[1][1]} * {c[2][0]}))"
    q = [[f"(q{min(j, k)}{max(j, k)}{' + alpha' if j == k else ''})" for k in (1, 2, 3)] for j in (1, 2, 3)]
    coef = [f"{det([[f't{r + 1}' if k == j else q[r][k] for k in range(3)] for r in range(3)])} / {det(q)} AS b{j + 1}" for j in range(3)]
    return (f"SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0 FROM (SELECT {keys}, alpha, m1, m2, m3, my, varies, {', '.join(coef)} "
            f"FROM (SELECT {keys}, {sums} FROM ({rows}) GROUP BY {keys}), {alpha})")


_ALPHAS = "(SELECT unnest([" + ", ".join(f"CAST({float(a)!r} AS DOUBLE)" for a in K.ALPHAS) + "]) AS alpha)"
_MISS = "SUM((z.y - b0 - b1 * z.x1 - b2 * z.x2 - b3 * z.x3) ** 2)"
_R2 = f"CASE WHEN var_pop(z.y) * COUNT(*) <= 1e-12 THEN CASE WHEN {_MISS} <= 1e-12 THEN 1.0 ELSE 0.0 END ELSE 1.0 - {_MISS} / (var_pop(z.y) * COUNT(*)) END"


def penalty(name: str, fold: str, where: str) -> None:
    CTE[f"{name}_fit"] = ridge(f"{G}, f", f"SELECT z.*, f FROM f_z z JOIN (SELECT DISTINCT {G}, {fold} AS f FROM f_z WHERE {where}) USING ({G}) WHERE {where} AND {fold} <> f", _ALPHAS)
    CTE[f"{name}_score"] = f"""
      SELECT {G}, alpha, AVG(r2) AS score FROM (SELECT {G}, f, alpha, {_R2} AS r2 FROM {name}_fit t JOIN f_z z USING ({G}) WHERE z.{fold} = f GROUP BY {G}, f, alpha) GROUP BY {G}, alpha"""
    CTE[name] = f"SELECT {G}, MIN(alpha) AS alpha FROM (SELECT *, MAX(score) OVER (PARTITION BY {G}) AS top FROM {name}_score) WHERE score >= top - 1e-9 GROUP BY {G}"


penalty("f_alpha", "outer_fold", "TRUE")
penalty("f_inner", "inner_fold", "held AND inner_fold >= 0")
CTE["f_coef"] = f"SELECT c.* FROM ({ridge(G, 'SELECT * FROM f_z', _ALPHAS)}) c JOIN f_alpha USING ({G}, alpha)"
CTE["f_hold_fit"] = f"SELECT c.* FROM ({ridge(G, 'SELECT * FROM f_z WHERE held AND inner_fold >= 0', _ALPHAS)}) c JOIN f_inner USING ({G}, alpha)"
CTE["f_hold"] = f"SELECT {G}, {_R2} AS holdout_r2 FROM f_hold_fit JOIN f_z z USING ({G}) WHERE z.held AND z.inner_fold = -1 GROUP BY {G}"


def drawn(keys: str, purpose: str) -> str:
    text = ", ".join(f"CAST({k.strip()} AS VARCHAR)" for k in keys.split(","))
    return f"CAST('0x' || substr(md5(concat_ws('|', {text}, '{purpose}', r, s // 4)), CAST(8 * (s % 4) + 1 AS INTEGER), 8) AS BIGINT) % n"


CTE["f_draw"] = f"""
  SELECT {G}, r, {drawn(G, 'stability')} AS idx FROM (
    SELECT *, unnest(range(0, LEAST(GREATEST(CAST(floor(n * 0.8) AS INTEGER), 30), n))) AS s FROM (SELECT DISTINCT {G}, n, unnest(range(0, 20)) AS r FROM (SELECT DISTINCT {G}, n FROM f_z)))"""
CTE["f_again"] = f"SELECT c.* FROM ({ridge(f'{G}, r', f'SELECT * FROM f_draw JOIN f_z USING ({G}, idx)', _ALPHAS)}) c JOIN f_alpha USING ({G}, alpha)"
CTE["f_kept"] = f"""
  SELECT {G}, {', '.join(f'COUNT(*) FILTER (a.varies AND CASE WHEN abs(a.b{j}) <= 1e-9 * sdy THEN 0 ELSE sign(a.b{j}) END = sign(c.b{j})) / 20 AS k{j}' for j in (1, 2, 3))} FROM f_again a JOIN f_coef c USING ({G}) JOIN (SELECT {G}, stddev_pop(y) AS sdy FROM f_z GROUP BY {G}) USING ({G}) GROUP BY {G}"""

CTE["f_pair"] = f"""
  SELECT {P}, a.slot, a.i, a.v AS x, b.v AS y, ROW_NUMBER() OVER (PARTITION BY {P} ORDER BY a.i) - 1 AS idx, COUNT(*) OVER (PARTITION BY {P}) AS n
  FROM (SELECT * FROM f_moved WHERE slot > 0 AND v IS NOT NULL) a JOIN (SELECT {G}, i, v FROM f_moved WHERE slot = 0 AND v IS NOT NULL) b USING ({G}, i)"""
CTE["f_line0"] = f"""
  SELECT {P}, n, COALESCE(corr(x, y), 0.0) AS r, MAX(x) <= MIN(x) AS flat, (COUNT(*) + SUM(x * x)) / 2 AS half, COUNT(*) * SUM(x * x) - SUM(x) ** 2 AS det FROM f_pair GROUP BY {P}, n"""
CTE["f_line"] = f"""
  SELECT *, CASE WHEN n >= 30 AND NOT flat AND det > 0 AND (half + sqrt(GREATEST(half * half - det, 0))) / sqrt(det) <= 30 THEN 'ols' WHEN n >= 15 THEN 'bootstrap' ELSE 'none' END AS validity_method,
         atan2(abs(r) * sqrt(n - 2), sqrt(1 - r * r) * sqrt(n - 2)) AS angle FROM f_line0 JOIN (SELECT DISTINCT {G}, p FROM f_z) USING ({G})"""
_TERM = """list_sum(list_transform(range(1, CAST(CASE WHEN (n - 2) % 2 = 1 THEN (n - 3) / 2 ELSE (n - 2) / 2 END AS INTEGER) + 1), lambda j:
      CASE WHEN (n - 2) % 2 = 1 THEN cos(angle) ** (2 * j - 1) * COALESCE(list_product(list_transform(range(1, j), lambda i: 2.0 * i / (2 * i + 1))), 1.0)
           ELSE cos(angle) ** (2 * j - 2) * COALESCE(list_product(list_transform(range(1, j), lambda i: (2.0 * i - 1) / (2 * i))), 1.0) END))"""
CTE["f_p"] = f"""
  SELECT {P}, LEAST(1.0, p * GREATEST(0.0, 1 - CASE WHEN (n - 2) % 2 = 1 THEN 2 / pi() * (angle + sin(angle) * {_TERM}) ELSE sin(angle) * {_TERM} END)) AS p_value
  FROM (SELECT {P}, n, p, atan2(abs(r), sqrt(1 - r * r)) AS angle FROM f_line WHERE validity_method = 'ols')"""
CTE["f_redraw"] = f"""
  SELECT {P}, p, r, {drawn(P, 'interval')} AS idx FROM (
    SELECT *, unnest(range(0, n)) AS s FROM (SELECT {P}, n, p, unnest(range(0, 500)) AS r FROM f_line WHERE validity_method = 'bootstrap'))"""
CTE["f_r"] = f"SELECT {P}, p, r, CASE WHEN stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN corr(x, y) END AS c FROM f_redraw JOIN f_pair USING ({P}, idx) GROUP BY {P}, p, r"
_ENDS = " ".join(f"WHEN {k} THEN quantile_cont(c, {0.05 / k / 2!r}) > 0 OR quantile_cont(c, {1 - 0.05 / k / 2!r}) < 0" for k in range(1, DRIVERS + 1))
CTE["f_beyond"] = f"SELECT {P}, COUNT(c) >= 30 AND CASE p {_ENDS} END AS beyond FROM f_r GROUP BY {P}, p"
CTE["fitted_table"] = f"""
  SELECT {P}, t.differenced AS driver_differenced, g.differenced AS component_differenced,
         CASE WHEN alpha IS NULL THEN 'insufficient_history' ELSE 'fitted' END AS model_status,
         COALESCE(CASE t.slot WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END, 0.0) AS historical_coefficient, holdout_r2, p_value,
         COALESCE(CASE validity_method WHEN 'ols' THEN p_value < 0.05 ELSE beyond END, FALSE) AS is_significant,
         COALESCE(CASE t.slot WHEN 1 THEN k1 WHEN 2 THEN k2 ELSE k3 END, 0.0) AS coefficient_stability, alpha, COALESCE(z.n, 0) AS n_observations, validity_method
  FROM (SELECT * FROM u_test WHERE driver <> '') t JOIN (SELECT {G}, differenced FROM u_test WHERE driver = '') g USING ({G})
  LEFT JOIN (SELECT DISTINCT {G}, n FROM f_row) z USING ({G}) LEFT JOIN f_coef USING ({G}) LEFT JOIN f_hold USING ({G}) LEFT JOIN f_kept USING ({G})
  LEFT JOIN (SELECT {P}, validity_method FROM f_line) USING ({P}) LEFT JOIN f_p USING ({P}) LEFT JOIN f_beyond USING ({P})"""

CTE["fev0"] = f"""
  SELECT *, CASE WHEN is_break THEN 'structural_break' WHEN fit = 'fitted' THEN 'historical_relationship' ELSE 'insufficient_evidence' END AS evidence_mode,
         CASE WHEN is_break THEN 'historical_variance_unavailable' ELSE fit END AS model_status,
         NOT is_break AND fit = 'fitted' AND significant AS is_significant,
         CASE WHEN is_break OR fit = 'fitted' THEN direction ELSE 'not_evaluated' END AS direction_consistency,
         CASE WHEN direction = 'contradictory' THEN 0.1 ELSE 1.0 END * mechanism_weight
           * CASE WHEN is_break THEN shift_score
                  WHEN fit = 'fitted' THEN LEAST(1.0, abs(historical_lag_correlation)) * severity * GREATEST(0.0, LEAST(1.0, stability)) * CASE WHEN significant THEN 1.0 ELSE 0.5 END
                  ELSE 0.0 END AS evidence_score
  FROM sig JOIN (SELECT {P}, model_status AS fit, is_significant AS significant, coefficient_stability AS stability FROM fitted_table) USING ({P})"""
CTE["fevidence"] = f"""
  SELECT *, ex / SUM(ex) OVER (PARTITION BY {G}) AS softmax_probability
  FROM (SELECT *, exp((normalized_score - MAX(normalized_score) OVER (PARTITION BY {G})) / 0.35) AS ex
        FROM (SELECT *, CASE WHEN MAX(evidence_score) OVER (PARTITION BY {G}) > 0 THEN evidence_score / MAX(evidence_score) OVER (PARTITION BY {G}) ELSE 0.0 END AS normalized_score FROM fev0))"""

ORACLES["driver_evidence"] = detected(f"""SELECT {P}, evidence_mode, model_status, direction_consistency, is_significant, best_lag_days,
  {nums('evidence_score normalized_score softmax_probability', 5)} FROM fevidence""")
ORACLES["stationarity"] = build(f"""SELECT {P}, t.differenced AS driver_differenced, g.differenced AS component_differenced
  FROM (SELECT * FROM u_test WHERE driver <> '') t JOIN (SELECT {G}, differenced FROM u_test WHERE driver = '') g USING ({G})""")
ORACLES["unit_roots"] = build(f"SELECT {P}, n, lag_order, degenerate, differenced, {nums('statistic:4')} FROM u_test")
ORACLES["component_model"] = build(f"""SELECT {P}, model_status, n_observations, validity_method, is_significant,
  {nums('historical_coefficient holdout_r2 p_value coefficient_stability alpha', 5)} FROM fitted_table""")
