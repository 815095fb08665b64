"""Gradient-boosted trees for a few classes, on arrays: small, deterministic, no dependency but numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Softmax boosting of depth-limited trees over quantile bins."""

    def __init__(self, classes: int, *, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.l2 = classes, rounds, depth, rate, bins, l2
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.scale = np.ones(classes)
        self.shift = np.zeros(classes)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], 1).astype(np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x = np.nan_to_num(x)
        self.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, self.bins + 1)[1:-1])) for i in range(x.shape[1])]
        b = self._binned(x)
        n, f = b.shape
        width = self.bins + 1
        present = np.bincount(y, minlength=self.classes)
        self.base = np.log(np.maximum(present, 0.5) / max(n, 1))
        self.base[present == 0] = -30.0
        weight = (n / (self.classes * np.maximum(present, 1)))[y] ** 0.5
        score = np.tile(self.base, (n, 1))
        offsets = np.arange(f, dtype=np.int64) * width
        for _ in range(self.rounds):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            trees = []
            for c in range(self.classes):
                g = (p[:, c] - (y == c)) * weight
                h = np.maximum(p[:, c] * (1 - p[:, c]), 1e-6) * weight
                feature = np.zeros(2**self.depth - 1, np.int32)
                cut = np.full(2**self.depth - 1, width, np.int32)  # everything goes left
                node = np.zeros(n, np.int64)
                for level in range(self.depth):
                    first, count = 2**level - 1, 2**level
                    at = ((node - first)[:, None] * (f * width) + offsets + b).ravel()
                    gs = np.bincount(at, np.repeat(g, f), count * f * width).reshape(count, f, width).cumsum(2)
                    hs = np.bincount(at, np.repeat(h, f), count * f * width).reshape(count, f, width).cumsum(2)
                    gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hs < 1) | (ht - hs < 1)] = 0
                    best = gain.reshape(count, -1).argmax(1)
                    good = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
                    feature[first : first + count] = np.where(good, best // width, 0)
                    cut[first : first + count] = np.where(good, best % width, width)
                    node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
                leaf = node - (2**self.depth - 1)
                value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
                trees.append((feature, cut, value))
                score[:, c] += value[leaf]
            self.trees.append(trees)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(np.nan_to_num(x))
        out = np.tile(self.base, (len(b), 1))
        rows = np.arange(len(b))
        for trees in self.trees:
            for c, (feature, cut, value) in enumerate(trees):
                node = np.zeros(len(b), np.int64)
                for _ in range(self.depth):
                    node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
                out[:, c] += value[node - (2**self.depth - 1)]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 300) -> Boosted:
        """One temperature and a shift per class on held-out rows, by gradient descent on the log loss with a pull towards no change."""
        s = self.scores(x)
        t, shift = 0.0, np.zeros(self.classes)
        for _ in range(steps):
            z = s * np.exp(t) + shift
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = p.copy()
            d[np.arange(len(y)), y] -= 1
            t -= 0.05 * ((d * s * np.exp(t)).sum() / max(len(y), 1) + 0.05 * t)
            shift -= 0.05 * (d.sum(0) / max(len(y), 1) + 0.05 * shift)
        self.scale, self.shift = np.full(self.classes, np.exp(t)), shift
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.scores(x) * self.scale + self.shift
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
