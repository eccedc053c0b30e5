"""Numerical kernels for one series or one incident component.

Inputs are bounded: a daily series (one value per calendar day) or at most 91 history
rows. Spark partitions and shuffles the groups; nothing here sees more than one.
"""

from __future__ import annotations

import math

import numpy as np

# Constants of the models.
MIN_SIZE = 10
JUMP = 5
MIN_SERIES = 30
PENALTY = 3.0
ADF_ALPHA = 0.05
ADF_MIN_ROWS = 12
ALPHAS = np.logspace(-3, 3, 25)
RESAMPLES = 20
RESAMPLE_SHARE = 0.8
DRAWS = 500
SEED = 1337
SIGNIFICANCE = 0.05
MIN_ROWS = 30
ROWS_PER_DRIVER = 10
MIN_OVERLAP = 15
MAX_CONDITION = 30.0
# Response surface of the unit-root test (constant, one series).
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


# --- changepoints -----------------------------------------------------------------

def pelt(values: np.ndarray, penalty: float, min_size: int = MIN_SIZE, jump: int = JUMP) -> list[int]:
    """Optimal L2 segmentation; breakpoints lie on multiples of ``jump``."""
    n = len(values)
    s1 = np.concatenate([[0.0], np.cumsum(values)])
    s2 = np.concatenate([[0.0], np.cumsum(values * values)])
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    previous = np.zeros(n + 1, dtype=int)
    starts = np.empty(0, dtype=int)
    ends = [e for e in range(jump, n, jump) if e >= min_size] + [n]
    for end in ends:
        fresh = (end - min_size) // jump * jump
        if np.isfinite(best[fresh]) and fresh not in starts[-1:]:
            starts = np.append(starts, fresh)
        span = s1[end] - s1[starts]
        open_cost = best[starts] + (s2[end] - s2[starts] - span * span / (end - starts))
        i = int(np.argmin(open_cost))
        best[end] = open_cost[i] + penalty
        previous[end] = starts[i]
        starts = starts[open_cost <= best[end]]
    cuts, at = [], int(previous[n])
    while at > 0:
        cuts.append(at)
        at = int(previous[at])
    return cuts[::-1]


def changepoints(values: np.ndarray, place: np.ndarray, gap: int, jump: int = JUMP) -> list[tuple[int, float, float]]:
    """(index, mean before, mean after) of the kept changepoints, in order.

    ``place`` gives the coordinate in which ``gap`` is measured: row numbers or day numbers.
    """
    n = len(values)
    if n < MIN_SERIES or np.isclose(np.std(values), 0.0):
        return []
    z = (values - values.mean()) / values.std()
    cuts = pelt(z, PENALTY * math.log(n) * float(np.var(z)), jump=jump)
    found = [(i, float(values[i - MIN_SIZE:i].mean()), float(values[i:i + MIN_SIZE].mean()))
             for i in cuts if MIN_SIZE <= i <= n - MIN_SIZE]
    kept: list[tuple[int, float, float]] = []
    for cand in sorted(found, key=lambda c: -abs(c[2] - c[1])):
        if all(abs(int(place[cand[0]]) - int(place[k[0]])) >= gap for k in kept):
            kept.append(cand)
    return sorted(kept)


# --- stationarity -----------------------------------------------------------------

def unit_root_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    poly = TAU_SMALL if tau <= TAU_STAR else TAU_LARGE
    u = sum(c * tau ** i for i, c in enumerate(poly))
    return 0.5 * math.erfc(-u / math.sqrt(2.0))


def _lagged(x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Response and [1, level, lagged differences] of the test regression."""
    d = np.diff(x)
    y = d[lags:]
    cols = [np.ones(len(y)), x[lags:-1]] + [d[lags - k:len(d) - k] for k in range(1, lags + 1)]
    return y, np.column_stack(cols)


def adf_p(x: np.ndarray) -> float | None:
    """Augmented Dickey-Fuller p-value with AIC lag choice; None when the design is singular."""
    n = len(x)
    lags = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)
    if lags < 0:
        return None
    y, full = _lagged(x, lags)
    if len(y) <= full.shape[1] or np.linalg.matrix_rank(full) < full.shape[1]:
        return None
    q, _ = np.linalg.qr(full)
    rss = float(y @ y) - np.cumsum((q.T @ y) ** 2)
    m = len(y)
    used = np.arange(2, lags + 3)
    with np.errstate(divide="ignore", invalid="ignore"):
        aic = m * (np.log(2 * np.pi) + np.log(np.maximum(rss[used - 1], 0.0) / m) + 1) + 2 * used
    pick = int(np.argmin(aic))
    y, design = _lagged(x, pick)
    freedom = len(y) - design.shape[1]
    if freedom <= 0:
        return None
    inverse = np.linalg.pinv(design.T @ design)
    beta = inverse @ (design.T @ y)
    err = y - design @ beta
    scale = float(err @ err) / freedom * inverse[1, 1]
    return unit_root_p(float(beta[1]) / math.sqrt(scale)) if scale > 0 else 0.0


class Placed:
    """A series that remembers the original row of every value."""

    def __init__(self, rows: np.ndarray, values: np.ndarray, n: int):
        self.rows, self.values, self.n = rows, values, n

    def shifted(self, lag: int) -> np.ndarray:
        """Values moved down by ``lag`` of its own rows, on the original rows."""
        out = np.full(self.n, np.nan)
        if lag < len(self.values):
            out[self.rows[lag:]] = self.values[:len(self.values) - lag]
        return out

    def usable(self) -> bool:
        v = self.values[~np.isnan(self.values)]
        return len(v) >= ADF_MIN_ROWS and not np.isinf(v).any() and not np.isclose(v.std(), 0.0)


def stationary(values: np.ndarray) -> tuple[Placed, bool]:
    """The series itself, its first difference, or zeros for a degenerate one; and whether it changed."""
    n = len(values)
    rows = np.arange(n)
    clean = values[~np.isnan(values)]
    if len(clean) < ADF_MIN_ROWS or np.isinf(clean).any() or np.isclose(clean.std(), 0.0):
        return Placed(rows, np.zeros(n), n), True
    try:
        p = adf_p(clean)
    except np.linalg.LinAlgError:
        p = None
    if p is not None and p <= ADF_ALPHA:
        return Placed(rows, values, n), False
    step = values[1:] - values[:-1]
    keep = ~np.isnan(step)
    return Placed(rows[1:][keep], step[keep], n), True


# --- ridge ------------------------------------------------------------------------

def ridge_path(x: np.ndarray, y: np.ndarray, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (alpha x feature) and intercepts of ridge regression with an unpenalised intercept."""
    mx, my = x.mean(axis=0), y.mean()
    values, vectors = np.linalg.eigh((x - mx).T @ (x - mx))
    target = vectors.T @ ((x - mx).T @ (y - my))
    coef = (target / (np.maximum(values, 0.0) + alphas[:, None])) @ vectors.T
    return coef, my - coef @ mx


def r2(y: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Coefficient of determination per row of ``fit``; a constant target scores 1 if hit, else 0."""
    miss = ((y - fit) ** 2).sum(axis=1)
    spread = float(((y - y.mean()) ** 2).sum())
    if spread == 0.0:
        return np.where(miss == 0.0, 1.0, 0.0)
    return 1.0 - miss / spread


def choose_alpha(x: np.ndarray, y: np.ndarray, folds: int) -> float:
    """Best mean R2 over contiguous folds; the smallest alpha wins a tie."""
    parts = np.array_split(np.arange(len(y)), folds)
    total = np.zeros(len(ALPHAS))
    for hold in parts:
        train = np.ones(len(y), dtype=bool)
        train[hold] = False
        coef, intercept = ridge_path(x[train], y[train], ALPHAS)
        total += r2(y[hold], coef @ x[hold].T + intercept[:, None])
    return float(ALPHAS[int(np.argmax(total / folds))])


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sd = x.std(axis=0)
    return x.mean(axis=0), np.where(sd < 10 * np.finfo(float).eps, 1.0, sd)


def sign_stability(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """Share of bootstrap refits that keep each coefficient's sign."""
    rng = np.random.default_rng(SEED)
    n = len(y)
    size = min(max(int(n * RESAMPLE_SHARE), MIN_ROWS), n)
    mean, sd = standardise(x)
    z, only = (x - mean) / sd, np.array([alpha])
    signs = np.sign(ridge_path(z, y, only)[0][0])
    kept = np.zeros(x.shape[1])
    for _ in range(RESAMPLES):
        pick = rng.choice(n, size=size, replace=True)
        if np.std(y[pick]) == 0:
            continue
        kept += np.sign(ridge_path(z[pick], y[pick], only)[0][0]) == signs
    return kept / RESAMPLES


def fit_component(x: np.ndarray, y: np.ndarray) -> dict | None:
    """Grouped ridge fit; None when there are too few rows for the number of drivers."""
    n, p = x.shape
    if n < max(MIN_ROWS, ROWS_PER_DRIVER * max(p, 1)):
        return None
    mean, sd = standardise(x)
    z = (x - mean) / sd
    alpha = choose_alpha(z, y, min(5, max(2, n // max(10, 5 * p))))
    cut = int(n * 0.8)
    holdout = None
    if cut >= 10 and n - cut >= 5:
        inner = choose_alpha(z[:cut], y[:cut], max(2, min(5, cut // 10)))
        coef, intercept = ridge_path(z[:cut], y[:cut], np.array([inner]))
        holdout = float(r2(y[cut:], coef @ z[cut:].T + intercept[:, None])[0])
    return {"alpha": alpha, "n": n, "holdout_r2": holdout,
            "coef": ridge_path(z, y, np.array([alpha]))[0][0], "stability": sign_stability(x, y, alpha)}


# --- validity ---------------------------------------------------------------------

def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * out


def student_p(t: float, freedom: float) -> float:
    """Two-sided p-value."""
    if math.isinf(t):
        return 0.0
    return beta_tail(freedom / 2.0, 0.5, freedom / (freedom + t * t))


def slope_p(x: np.ndarray, y: np.ndarray) -> float:
    """p-value of the slope in a regression on one driver."""
    dx, dy = x - x.mean(), y - y.mean()
    sxx = float(dx @ dx)
    slope = float(dx @ dy) / sxx
    miss = dy - slope * dx
    se = math.sqrt(float(miss @ miss) / (len(x) - 2) / sxx)
    return student_p(slope / se if se > 0 else math.inf, len(x) - 2)


def bootstrap_significant(x: np.ndarray, y: np.ndarray, candidates: int) -> tuple[str, bool]:
    """Whether the widened percentile interval of the correlation excludes zero."""
    n = len(x)
    if n < MIN_OVERLAP:
        return "none", False
    pick = np.random.default_rng(SEED).integers(0, n, size=(DRAWS, n))
    bx, by = x[pick], y[pick]
    sx, sy = bx.std(axis=1), by.std(axis=1)
    ok = (sx > 0) & (sy > 0)
    if ok.sum() < 30:
        return "bootstrap", False
    cov = ((bx - bx.mean(axis=1, keepdims=True)) * (by - by.mean(axis=1, keepdims=True))).mean(axis=1)
    r = cov[ok] / (sx[ok] * sy[ok])
    tail = 100 * SIGNIFICANCE / max(1, candidates) / 2
    low, high = np.percentile(r, [tail, 100 - tail])
    return "bootstrap", bool(low > 0 or high < 0)


def validity(x: np.ndarray, y: np.ndarray, candidates: int) -> tuple[str, float | None, bool]:
    """(method, corrected p-value, significant) for one driver of a component."""
    if len(x) < MIN_ROWS or x.std() == 0 or np.linalg.cond(np.column_stack([np.ones(len(x)), x])) > MAX_CONDITION:
        method, significant = bootstrap_significant(x, y, candidates)
        return method, None, significant
    p = min(1.0, slope_p(x, y) * max(1, candidates))
    return "ols", p, p < SIGNIFICANCE
