"""Gradient-boosted trees for two classes, in numpy: logistic loss, Newton leaves,
level-wise trees over quantile bins, and Platt calibration."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 24, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees, self.base, self.scale, self.shift = [], 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self.rate * self._run(tree, b)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], 1)

    def _grow(self, b, g, h):
        """Arrays of a full tree: feature (-1: leaf), bin, value."""
        n = 2 ** (self.depth + 1) - 1
        feature, split, value = np.full(n, -1), np.zeros(n, int), np.zeros(n)
        node, width = np.zeros(len(g), int), self.bins + 1
        for at in range(n):
            here = node == at
            gs, hs = g[here].sum(), h[here].sum()
            value[at] = gs / (hs + self.ridge)
            if at >= 2 ** self.depth - 1 or here.sum() < 8:
                continue
            best, parent = 1e-6, gs * gs / (hs + self.ridge)
            for j in range(b.shape[1]):
                left_g = np.cumsum(np.bincount(b[here, j], g[here], width))[:-1]
                left_h = np.cumsum(np.bincount(b[here, j], h[here], width))[:-1]
                gain = left_g ** 2 / (left_h + self.ridge) + (gs - left_g) ** 2 / (hs - left_h + self.ridge) - parent
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[at], split[at] = gain[k], j, k
            if feature[at] >= 0:
                node[here] = 2 * at + 1 + (b[here, feature[at]] > split[at])
        return feature, split, value

    def _run(self, tree, b):
        feature, split, value = tree
        node = np.zeros(len(b), int)
        for _ in range(self.depth):
            f = feature[node]
            go = np.flatnonzero(f >= 0)
            node[go] = 2 * node[go] + 1 + (b[go, f[go]] > split[node[go]])
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + self.rate * sum(self._run(t, b) for t in self.trees)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt scaling of the margin on rows not used for fitting."""
        m = self.margin(x)
        a, c = 1.0, 0.0
        for _ in range(50):  # damped Newton steps on (a, c)
            p = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
            w, r = p * (1 - p) + 1e-6, y - p
            hess = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, [(r * m).sum() + (1 - a), r.sum()])
            a, c = a + step[0], c + step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.scale, self.shift = float(a), float(c)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(x) + self.shift, -30, 30)))
