"""Linear support vector machines: L2-regularised squared hinge loss, by Nesterov's gradient method."""

from __future__ import annotations

import numpy as np


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 200, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last one is the bias) that separate y = 1 from y = -1; classes weigh the same unless weight says otherwise."""
    y = y.astype(np.float32)
    if weight is None:
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    c = weight.astype(np.float32)
    # The largest curvature, by power iteration.
    v = np.ones(x.shape[1] + 1, dtype=np.float32)
    for _ in range(12):
        v /= np.linalg.norm(v) + 1e-12
        z = c * (x @ v[:-1] + v[-1])
        v = np.append(x.T @ z, z.sum())
    step = 1 / (2 * np.linalg.norm(v) * 1.1 + penalty + 1e-12)
    w = u = np.zeros(x.shape[1] + 1, dtype=np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ u[:-1] + u[-1])) * c * y
        grad = np.append(-2 * (x.T @ slack) + penalty * u[:-1], -2 * slack.sum()).astype(np.float32)
        w, before = (u - step * grad).astype(np.float32), w
        u = (w + k / (k + 3) * (w - before)).astype(np.float32)
    return w
