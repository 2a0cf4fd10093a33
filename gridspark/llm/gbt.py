"""Gradient-boosted trees for a yes/no label, on histograms, in NumPy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete binary trees of one depth; ``fit`` on the driver, ``predict`` anywhere."""

    def __init__(self, rounds: int = 60, depth: int = 5, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, min_weight: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.min_weight = rounds, depth, rate, bins, ridge, min_weight

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1).astype(np.int32)

    def _histograms(self, flat: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, many: int, g_up: np.ndarray, h_up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of g and h by node, feature and bin; of two siblings the smaller is counted, the other is what is left of their parent."""
        width, sizes = flat.shape[1], np.bincount(node, minlength=many)
        counted = np.ones(1, bool) if many == 1 else np.repeat(sizes[::2] <= sizes[1::2], 2) ^ np.tile([False, True], many // 2)
        rows = np.flatnonzero(counted[node])
        at = (node[rows, None] * (width * self.bins) + flat[rows]).ravel()
        out = []
        for x, up in ((g, g_up), (h, h_up)):
            own = np.bincount(at, np.repeat(x[rows], width), many * width * self.bins).reshape(many, width, self.bins)
            if many > 1:
                left = np.flatnonzero(~counted)
                own[left] = up[left // 2] - own[left ^ 1]
            out.append(own)
        return out[0], out[1]

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(width)]
        b = self._binned(x)
        rate = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(rate / (1 - rate)))
        z = np.full(n, self.base)
        flat = np.arange(width) * self.bins + b
        inner = 2**self.depth - 1
        self.feature, self.cut = np.zeros((self.rounds, inner), np.int32), np.full((self.rounds, inner), self.bins, np.int32)
        self.leaf = np.zeros((self.rounds, inner + 1))
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            g_hist = h_hist = np.zeros((0, width, self.bins))
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                g_hist, h_hist = self._histograms(flat, node - first, g, h, many, g_hist, h_hist)
                gs, hs = g_hist.cumsum(axis=2), h_hist.cumsum(axis=2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < self.min_weight) | (ht - hs < self.min_weight)] = 0
                best = gain.reshape(many, -1).argmax(axis=1)
                good = gain.reshape(many, -1)[np.arange(many), best] > 1e-6
                self.feature[t, first : first + many] = best // self.bins
                self.cut[t, first : first + many] = np.where(good, best % self.bins, self.bins)
                node = 2 * node + 1 + (b[np.arange(n), self.feature[t, node]] > self.cut[t, node])
            leaf = node - inner
            gl, hl = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            self.leaf[t] = -self.rate * gl / (hl + self.ridge)
            z += self.leaf[t, leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of yes for each row."""
        if not len(x):
            return np.zeros(0)
        b, rows, z = self._binned(x), np.arange(len(x)), np.full(len(x), self.base)
        for t in range(self.rounds):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, self.feature[t, node]] > self.cut[t, node])
            z += self.leaf[t, node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-z))
