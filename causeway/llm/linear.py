"""Small linear models, fitted on the driver to bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, chosen by a hash of the key so that the choice repeats."""
    return rows.orderBy(F.xxhash64(F.lit(29), key), key).limit(limit)


def descend(grad, size: int, step: float, rounds: int) -> np.ndarray:
    """Minimise a smooth convex function by accelerated gradient steps."""
    w = v = np.zeros(size)
    for k in range(rounds):
        new = v - step * grad(v)
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), x.dtype)])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-5, rounds: int = 300) -> np.ndarray:
    """Weights (last: bias) of an L2-penalised logistic regression. y: 0 or 1."""
    x = with_bias(x)
    top = float((x * x).sum()) / len(x) / 4 + penalty
    return descend(lambda w: x.T @ (sigmoid(x @ w) - y) / len(x) + penalty * w, x.shape[1], 1 / top, rounds)


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights (last: bias) of a linear support vector machine with squared hinge loss; classes weigh the same. y: -1 or 1."""
    x = with_bias(x)
    weight = np.where(y > 0, 0.5 / max(1, int((y > 0).sum())), 0.5 / max(1, int((y < 0).sum())))
    top = 2 * float((weight[:, None] * x * x).sum()) + penalty
    return descend(lambda w: -2 * (x.T @ (weight * y * np.maximum(0, 1 - y * (x @ w)))) + penalty * w, x.shape[1], 1 / top, rounds)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
