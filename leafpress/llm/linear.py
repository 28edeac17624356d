"""Linear hinge-loss models by dual coordinate descent, and calibration."""

from __future__ import annotations

import numpy as np


def dual_coordinate_descent(rows: list, y: np.ndarray, dim: int, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """w that minimises |w|^2/2 + sum(cost * max(0, 1 - y * w.x)).

    rows: one (ids, values) pair per example. Each step solves one dual variable in [0, cost]
    exactly and updates w; variables at a bound with a gradient pointing outwards are passed by.
    """
    w, alpha = np.zeros(dim), np.zeros(len(rows))
    norm = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if norm[i] == 0:
                continue
            ids, v = rows[i]
            g = y[i] * (w[ids] @ v) - 1
            if (alpha[i] <= 0 and g >= 0) or (alpha[i] >= cost[i] and g <= 0):
                continue
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            step = new - alpha[i]
            w[ids] += step * y[i] * v
            alpha[i] = new
            moved = max(moved, abs(step) * norm[i])
        if moved < 1e-3:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """(a, b) so that 1/(1+exp(-(x @ a + b))) is the probability of y = 1; y in 0, 1. Newton steps, light ridge."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    if not pos or not neg:
        return np.zeros(x.shape[1]), 30.0 if pos else -30.0
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = np.maximum(np.std(x, axis=0), 1e-9)
    z = np.column_stack([x / scale, np.ones(len(x))])
    t, ridge = np.zeros(z.shape[1]), 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ t, -35, 35)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1])
        step = np.linalg.solve(h, z.T @ (goal - p) - ridge * t)
        t += np.clip(step, -5, 5)
        if abs(step).max() < 1e-7:
            break
    return t[:-1] / scale, float(t[-1])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the logistic curve over one margin."""
    a, b = logistic(margin[:, None], y)
    return float(a[0]), b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
