"""Histogram gradient-boosted trees: fitted on a bounded sample, flattened into arrays.

Fitting works on a NumPy matrix that holds a bounded sample on the driver.
Scoring is a vectorised walk over the arrays inside tasks, or the same trees as
one Spark SQL expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: feature and threshold of inner nodes, value of leaves.

    Row x goes left at node k (children 2k+1, 2k+2) if x[feature] <= threshold.
    """

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))

    def sql(self, names: list[str]) -> str:
        """The margin as a Spark SQL expression over columns of those names."""
        inner = 2**self.depth - 1

        def node(tree: int, k: int) -> str:
            if k >= inner:
                return f"{self.value[tree][k - inner]!r}D".replace("np.float64(", "").replace(")D", "D")
            left, right = node(tree, 2 * k + 1), node(tree, 2 * k + 2)
            if left == right:
                return left
            t = float(self.threshold[tree][k])
            return f"if({names[self.feature[tree][k]]} <= {t!r}D, {left}, {right})" if math.isfinite(t) else left

        return " + ".join([f"{self.base!r}D", *(node(t, 0) for t in range(len(self.feature)))])


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Trees for the log-odds of y = 1. One class or no rows give a constant."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = [], [], []
    if 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                best = np.full(count, 1e-6)
                pick = np.full((count, 2), -1)
                for f in range(width):
                    cell = (node - first) * (bins + 1) + binned[:, f]
                    size = count * (bins + 1)
                    G, H, N = (np.bincount(cell, w, size).reshape(count, -1).cumsum(axis=1) for w in (g, h, None))
                    total = G[:, -1:] ** 2 / (H[:, -1:] + ridge)
                    gain = G**2 / (H + ridge) + (G[:, -1:] - G) ** 2 / (H[:, -1:] - H + ridge) - total
                    gain[(N < least) | (N[:, -1:] - N < least)] = 0
                    gain[:, len(edges[f]) :] = 0
                    at = gain.argmax(axis=1)
                    own = gain[np.arange(count), at]
                    better = own > best
                    best[better], pick[better, 0], pick[better, 1] = own[better], f, at[better]
                for k in np.flatnonzero(pick[:, 0] >= 0):
                    feature[first + k], threshold[first + k] = pick[k, 0], edges[pick[k, 0]][pick[k, 1]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
            leaf = node - inner
            value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
            margin += value[leaf]
            features.append(feature), thresholds.append(threshold), values.append(value)
    return Trees(base, np.array(features).reshape(-1, inner), np.array(thresholds).reshape(-1, inner), np.array(values).reshape(-1, leaves), depth)
