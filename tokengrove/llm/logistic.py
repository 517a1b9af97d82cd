"""Logistic regression on a bounded sample, for calibration and small linear models."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients and, last, the intercept; Newton steps with a ridge on the coefficients."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    weight = weight / max(weight.sum(), 1e-12)
    for _ in range(50):
        p = sigmoid(x @ beta)
        gradient = x.T @ (weight * (p - y)) + penalty * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit_sparse(
    rows: np.ndarray,
    cols: np.ndarray,
    values: np.ndarray,
    y: np.ndarray,
    width: int,
    rounds: int = 80,
    rate: float = 0.5,
    ridge: float = 1e-6,
) -> tuple[np.ndarray, float]:
    """Weights and bias for sparse features by full-batch Adam; the classes weigh the same."""
    n = len(y)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, bias = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for k in range(1, rounds + 1):
        p = sigmoid(np.bincount(rows, weights=values * w[cols], minlength=n) + bias)
        error = share * (p - y)
        gradient = np.empty(width + 1)
        gradient[:-1] = np.bincount(cols, weights=values * error[rows], minlength=width) + ridge * w
        gradient[-1] = error.sum()
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return w, float(bias)
