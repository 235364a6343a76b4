"""Gradient-boosted trees for a yes/no target, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of fixed depth on quantile-binned features, fitted to the logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 32, smooth: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.smooth = trees, depth, rate, bins, smooth
        self.bias = 0.0
        self.splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        total = np.full(len(y), self.bias)
        inner = (1 << self.depth) - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-total))
            gradient, hessian = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(self.depth):
                for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                    rows = np.flatnonzero(node == k)
                    best = self._best(binned[rows], gradient[rows], hessian[rows], edges) if len(rows) > 1 else None
                    if best:
                        feature[k], cut[k] = best
                    node[rows] = 2 * k + 1 + (x[rows, feature[k]] > cut[k])
            leaf = node - inner
            g = np.bincount(leaf, gradient, 1 << self.depth)
            h = np.bincount(leaf, hessian, 1 << self.depth)
            value = self.rate * g / (h + self.smooth)
            self.splits.append((feature, cut, value))
            total += value[leaf]
        return self

    def _best(self, binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, edges: list[np.ndarray]) -> tuple[int, float] | None:
        all_g, all_h = gradient.sum(), hessian.sum()
        floor, found = all_g**2 / (all_h + self.smooth) + 1e-6, None
        for f, e in enumerate(edges):
            if not len(e):
                continue
            g = np.cumsum(np.bincount(binned[:, f], gradient, len(e) + 1))[:-1]
            h = np.cumsum(np.bincount(binned[:, f], hessian, len(e) + 1))[:-1]
            gain = g**2 / (h + self.smooth) + (all_g - g) ** 2 / (all_h - h + self.smooth)
            at = int(np.argmax(gain))
            if gain[at] > floor:
                floor, found = gain[at], (f, float(e[at]))
        return found

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in self.splits:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - len(feature)]
        return total
