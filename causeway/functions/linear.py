"""Least squares from cross-moments.

Spark sums the products of every two features over the rows of a group; the small matrices, flat arrays
of a few hundred numbers at most, are then solved a batch at a time. The last feature is the target.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions import kernels as K

#: A pivot below this share of its own moment counts as zero: the column depends on those before it.
DEPENDENT = 1e-10
#: Criteria and mean scores this near count as equal: the smaller order and the smaller penalty are taken.
EQUAL = 1e-9


def cross_moments(features: list[Column]) -> Column:
    """Aggregate: sums of products of every two features, the upper triangle row by row."""
    every = range(len(features))
    return F.array(*[F.sum(features[a] * features[b]) for a in every for b in every[a:]])


def added(m: str, size: int) -> Column:
    """Aggregate: sum of the moments of ``size`` features in column ``m``."""
    return F.array(*[F.sum(F.get(m, F.lit(k))) for k in range(size * (size + 1) // 2)])


def minus(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda u, v: u - v)


def squares(m: pd.Series) -> np.ndarray:
    """A batch of symmetric matrices from their upper triangles."""
    flat = np.stack(m.to_numpy()).astype(float)
    size = width(flat.shape[1])
    out = np.zeros((len(flat), size, size))
    a, b = np.triu_indices(size)
    out[:, a, b] = out[:, b, a] = flat
    return out


def width(cells: int) -> int:
    return (math.isqrt(8 * cells + 1) - 1) // 2


def eliminate(m: np.ndarray, first: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrices, rests, dependent): ``count`` columns from ``first`` on taken out of all later ones in turn.

    ``rests``: the last diagonal cell after each step, the residual sum of squares of a fit on the columns so far;
    ``dependent``: whether a column depended on those before it (columns of zeros are skipped).
    """
    m, own = m.copy(), np.einsum("bii->bi", m).copy()
    rests, dependent = np.zeros((len(m), count)), np.zeros(len(m), bool)
    for c in range(first, first + count):
        pivot = m[:, c, c]
        dead = ~(pivot > DEPENDENT * own[:, c])
        dependent |= dead & (own[:, c] > 0)
        share = np.where(dead[:, None], 0.0, m[:, c + 1:, c] / np.where(dead, 1.0, pivot)[:, None])
        m[:, c + 1:, :] -= share[:, :, None] * m[:, c, None, :]
        rests[:, c - first] = m[:, -1, -1]
    return m, rests, dependent


@F.pandas_udf(T.IntegerType())
def lag_order(m: pd.Series, rows: pd.Series, lags: pd.Series) -> pd.Series:
    """Number of lagged differences of least AIC. ``m``: moments of (1, level, lagged differences, difference); NULL for a singular design."""
    _, rests, dependent = eliminate(squares(m), 0, width(len(m.iloc[0])) - 1)
    n, most = rows.to_numpy(float)[:, None], lags.to_numpy(int)
    used = np.arange(2, rests.shape[1] + 1)
    aic = n * (np.log(2 * np.pi) + np.log(np.maximum(rests[:, 1:], 1e-300) / n) + 1) + 2 * used
    aic[used[None, :] > most[:, None] + 2] = np.inf
    order = (aic <= aic.min(1)[:, None] + EQUAL).argmax(1)
    fits = ~dependent & (n[:, 0] > most + 2)
    return pd.Series(np.where(fits, order, 0)).where(fits).astype("Int32")


@F.pandas_udf(T.DoubleType())
def level_statistic(m: pd.Series, rows: pd.Series, order: pd.Series) -> pd.Series:
    """t-statistic of the level. ``m``: moments of (1, lagged differences, level, difference)."""
    size = width(len(m.iloc[0]))
    left, _, _ = eliminate(squares(m), 0, size - 2)
    level, effect, total = left[:, -2, -2], left[:, -2, -1], left[:, -1, -1]
    freedom = rows.to_numpy(float) - order.to_numpy(float) - 2
    with np.errstate(divide="ignore", invalid="ignore"):
        variance = (total - effect * effect / level) / freedom / level
        tau = np.where(variance > 0, effect / level / np.sqrt(variance), -np.inf)
    return pd.Series(tau).where(freedom > 0)


def ridges(m: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """(batch, alpha, coefficient) of ridge regressions with a free intercept. ``m``: moments of (1, drivers, target)."""
    centred = eliminate(m, 0, 1)[0]
    heavy = centred[:, None, 1:-1, 1:-1] + alphas[..., None, None] * np.eye(m.shape[1] - 2)
    target = np.broadcast_to(centred[:, None, 1:-1, -1:], (*heavy.shape[:-1], 1))
    return np.linalg.solve(heavy, target)[..., 0]


def scores(m: np.ndarray, train: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """(batch, alpha) coefficient of determination over the rows of ``m``; the intercepts come from ``train``."""
    intercept = (train[:, None, 0, -1] - np.einsum("bak,bk->ba", coef, train[:, 0, 1:-1])) / train[:, None, 0, 0]
    w = np.concatenate([-intercept[..., None], -coef, np.ones_like(intercept)[..., None]], axis=-1)
    miss = np.einsum("baj,bjk,bak->ba", w, m, w)
    spread = (m[:, -1, -1] - m[:, 0, -1] ** 2 / m[:, 0, 0])[:, None]
    flat = spread <= 1e-12
    return np.where(flat, np.where(miss <= 1e-12, 1.0, 0.0), 1.0 - miss / np.where(flat, 1.0, spread))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def penalty_scores(m: pd.Series, train: pd.Series) -> pd.Series:
    """R2 on a fold of the fits to its training moments, for every penalty."""
    m, train = squares(m), squares(train)
    return pd.Series(list(scores(m, train, ridges(train, np.broadcast_to(K.ALPHAS, (len(m), len(K.ALPHAS)))))))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def coefficients(m: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series(list(ridges(squares(m), alpha.to_numpy(float)[:, None])[:, 0]))


@F.pandas_udf(T.DoubleType())
def fit_score(m: pd.Series, train: pd.Series, alpha: pd.Series) -> pd.Series:
    m, train = squares(m), squares(train)
    return pd.Series(scores(m, train, ridges(train, alpha.to_numpy(float)[:, None]))[:, 0])


@cache
def critical_statistic() -> float:
    """The unit-root statistic at which the test's p-value is its level."""
    low, high = K.TAU_MIN, K.TAU_MAX
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if K.unit_root_p(middle) <= K.ADF_ALPHA else (low, middle)
    return low
