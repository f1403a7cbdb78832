"""Linear models in numpy: logistic regression and squared-hinge support vector machines."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _slope_logistic(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return sigmoid(z) - (y > 0)


def _slope_hinge(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return -2 * y * np.maximum(0, 1 - y * z)


class Sparse:
    """Rows of (column, value) pairs, with dense columns after them."""

    def __init__(self, columns: list[list[int]], values: list[list[float]], width: int, dense: np.ndarray | None = None):
        self.rows = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
        self.columns = np.array([c for own in columns for c in own], np.int64)
        self.values = np.array([v for own in values for v in own], np.float64)
        self.width, self.n = width, len(columns)
        self.dense = np.zeros((self.n, 0)) if dense is None else dense

    @property
    def shape(self) -> tuple[int, int]:
        return self.n, self.width + self.dense.shape[1]

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        own = np.bincount(self.rows, self.values * w[self.columns], self.n)
        return own + self.dense @ w[self.width :]

    def back(self, g: np.ndarray) -> np.ndarray:
        """The transpose times g."""
        own = np.bincount(self.columns, self.values * g[self.rows], self.width)
        return np.concatenate([own, self.dense.T @ g])

    def take(self, keep: np.ndarray) -> Sparse:
        """The rows where `keep` is true."""
        out = Sparse([], [], self.width, self.dense[keep])
        place, own = np.cumsum(keep) - 1, keep[self.rows]
        out.rows, out.columns, out.values, out.n = place[self.rows[own]], self.columns[own], self.values[own], int(keep.sum())
        return out

    def only(self, allowed: np.ndarray) -> Sparse:
        """With the sparse columns that are allowed; the others hold nothing."""
        out, own = Sparse([], [], self.width, self.dense), allowed[self.columns]
        out.rows, out.columns, out.values, out.n = self.rows[own], self.columns[own], self.values[own], self.n
        return out

    def beside(self, column: np.ndarray) -> Sparse:
        """With one more dense column."""
        out = Sparse([], [], self.width, np.hstack([self.dense, column[:, None]]))
        out.rows, out.columns, out.values, out.n = self.rows, self.columns, self.values, self.n
        return out


def fit(x: np.ndarray | Sparse, y: np.ndarray, loss: str, ridge: float, steps: int = 300, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights and, last, the bias, by accelerated gradient steps; y is -1 or 1. Deterministic."""
    slope, bend = (_slope_logistic, 0.25) if loss == "logistic" else (_slope_hinge, 2.0)
    n, d = x.shape
    back = x.back if isinstance(x, Sparse) else lambda g: x.T @ g.astype(x.dtype)
    each = np.ones(n) / max(n, 1) if weight is None else weight / weight.sum()
    v = np.ones(d + 1) / np.sqrt(d + 1)
    top = 1.0
    for _ in range(20):  # the largest curvature, by power iteration
        u = each * (x @ v[:d] + v[d])
        v = np.append(back(u), u.sum())
        top = float(np.linalg.norm(v)) or 1.0
        v = v / top
    rate = 1 / (1.1 * bend * top + ridge)
    w = np.zeros(d + 1)
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        g = each * slope(x @ ahead[:d] + ahead[d], y)
        new = ahead - rate * np.append(back(g) + ridge * ahead[:d], g.sum())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w
