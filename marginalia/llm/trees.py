"""Gradient-boosted trees on histograms, and Platt's calibration."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary logistic boosting; trees of fixed depth stored as arrays, so that scoring is a few gathers per tree."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 8, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.scale, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        code = np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)])
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        self.feature = np.zeros((self.trees, inner), np.int32)
        self.cut = np.full((self.trees, inner), np.inf)
        self.value = np.zeros((self.trees, leaves))
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first = (1 << level) - 1
                width = 1 << level
                best = np.full(width, 1e-6)
                for j in range(f):
                    k = len(self.edges[j]) + 1
                    if k < 2:
                        continue
                    key = node * k + code[:, j]
                    sums = [np.bincount(key, w, width * k).reshape(width, k).cumsum(1) for w in (g, h, np.ones(n))]
                    gl, hl, nl = (s[:, :-1] for s in sums)
                    gt, ht, nt = (s[:, -1:] for s in sums)
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(nl < self.least) | (nt - nl < self.least)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    for w in np.flatnonzero(top > best):
                        best[w] = top[w]
                        self.feature[t, first + w], self.cut[t, first + w] = j, self.edges[j][at[w]]
                node = 2 * node + (x[np.arange(n), self.feature[t, first + node]] >= self.cut[t, first + node])
            gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            self.value[t] = self.rate * gs / (hs + self.ridge)
            score += self.value[t][node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, self.feature[t, at]] >= self.cut[t, at])
            out += self.value[t][node]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> BoostedTrees:
        """Fit scale and shift of the margin on a holdout, with Platt's smoothed targets."""
        m = self.margin(x)
        up, down = y.sum(), len(y) - y.sum()
        target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a * m + b)))
            d, w = p - target, p * (1 - p) + 1e-9
            g = np.array([(d * m).sum() + 1e-3 * (a - 1), d.sum()])
            h = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum()]]) + 1e-6 * np.eye(2)
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -1, 1)
        self.scale, self.shift = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(x) + self.shift, -50, 50)))
