"""Ridge logistic regression for small feature vectors, on a bounded sample."""

from __future__ import annotations

import numpy as np


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30):
    """Newton steps on scaled features: (mean, scale, weights with the constant last)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    penalty = ridge * np.append(np.ones(x.shape[1]), 1e-6)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w
