"""Small models on bounded samples: penalised logistic regression and shallow trees, in NumPy."""

from __future__ import annotations

import numpy as np


def logistic(x: np.ndarray, y: np.ndarray, l1: float = 0.0, l2: float = 1e-3, steps: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) for columns of x of similar scale, by accelerated proximal gradient."""
    n, k = x.shape
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    bias, w = np.log(base / (1 - base)), np.zeros(k)
    if n < 2 or not 0 < y.mean() < 1:
        return float(bias), w
    rate = 4.0 / (np.linalg.norm(np.column_stack([np.ones(n), x]), 2) ** 2 / n + 4 * l2)
    now, last, t = np.append(bias, w), np.append(bias, w), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(now[0] + x @ now[1:], -30, 30)))
        grad = np.append((p - y).mean(), x.T @ (p - y) / n + l2 * now[1:])
        new = now - rate * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * l1, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        now, last, t = new + (t - 1) / after * (new - last), new, after
    return float(last[0]), last[1:]


Condition = tuple[int, bool, float]  # column, whether it is over the threshold, threshold


def tree_paths(x: np.ndarray, y: np.ndarray, depth: int, made: np.random.Generator, cuts: int = 16) -> list[tuple[Condition, ...]]:
    """The paths to all nodes of one tree, grown greedily on Gini impurity over random halves of the columns."""
    paths: list[tuple[Condition, ...]] = []

    def grow(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        if path:
            paths.append(path)
        if len(path) == depth or len(rows) < 20 or y[rows].min() == y[rows].max():
            return
        best = (0.0, None)
        columns = made.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False)
        for c in columns:
            values = x[rows, c]
            for cut in np.unique(np.quantile(values, np.linspace(0.02, 0.98, cuts))):
                over = values > cut
                k = int(over.sum())
                if 5 <= k <= len(rows) - 5:
                    p, q, a = y[rows][over].mean(), y[rows][~over].mean(), y[rows].mean()
                    gain = a * (1 - a) - (k * p * (1 - p) + (len(rows) - k) * q * (1 - q)) / len(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, (int(c), float(cut)))
        if best[1]:
            c, cut = best[1]
            over = x[rows, c] > cut
            grow(rows[over], (*path, (c, True, cut)))
            grow(rows[~over], (*path, (c, False, cut)))

    grow(np.arange(len(y)), ())
    return paths
