"""Gradient-boosted trees on quantile bins, in numpy, for two classes."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth on logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.cuts: list[np.ndarray] = []
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(self.cuts)], 1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        n, width = x.shape
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        b, size = self._binned(x), self.bins
        mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        raw = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            feature = np.zeros((1 << self.depth) - 1, np.int64)
            cut = np.full((1 << self.depth) - 1, size, np.int64)
            for level in range(self.depth):
                first, many = (1 << level) - 1, 1 << level
                at = ((node - first)[:, None] * width + np.arange(width)) * size + b
                shape = (many, width, size)
                gs = np.bincount(at.ravel(), np.repeat(g, width), many * width * size).reshape(shape).cumsum(2)
                hs = np.bincount(at.ravel(), np.repeat(h, width), many * width * size).reshape(shape).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain = np.where((hs < self.least) | (ht - hs < self.least), -1, gain).reshape(many, -1)
                best = gain.argmax(1)
                split = gain[np.arange(many), best] > 1e-6
                feature[first : first + many] = best // size
                cut[first : first + many] = np.where(split, best % size, size)
                node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
            leaf = node - ((1 << self.depth) - 1)
            gl, hl = np.bincount(leaf, g, 1 << self.depth), np.bincount(leaf, h, 1 << self.depth)
            value = self.rate * gl / (hl + 1)
            raw += value[leaf]
            self.model.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the second class."""
        x = np.asarray(x, np.float64)
        if not len(x):
            return np.zeros(0)
        b, raw, rows = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.model:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            raw += value[node - ((1 << self.depth) - 1)]
        return 1 / (1 + np.exp(-raw))
