"""Small linear models fitted on the driver, on bounded samples, with numpy."""

from __future__ import annotations

import numpy as np


def svm(gram: np.ndarray, y: np.ndarray, reg: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Each row's part in the weights (their sum over rows) of a linear support vector machine (squared hinge loss, labels -1 and 1).

    Accelerated gradient descent; classes weigh alike. ``gram`` has the rows' inner products, so that a step costs
    their number squared, however many features there are.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    v, size = np.full(len(y), 1 / np.sqrt(len(y))), 1.0
    for _ in range(20):  # the largest curvature
        v = weight * (gram @ v)
        size = np.linalg.norm(v) or 1.0
        v /= size
    step = 1 / (2 * size * 1.1 + reg)
    w, ahead = np.zeros(len(y)), np.zeros(len(y))
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (gram @ ahead))
        new = ahead - step * (reg * ahead - 2 * weight * y * slack)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, reg: float = 1e-3, steps: int = 60, prior: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression (labels 0 and 1) by Newton's method, drawn to ``prior``. ``x`` has a last column of ones."""
    prior = np.zeros(x.shape[1]) if prior is None else prior
    w = prior.copy()
    ridge = np.full(x.shape[1], reg)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + ridge * (w - prior)
        curve = (x.T * (p * (1 - p))) @ x / len(y) + np.diag(ridge)
        change = np.linalg.solve(curve, slope)
        w -= change
        if np.abs(change).max() < 1e-8:
            break
    return w
