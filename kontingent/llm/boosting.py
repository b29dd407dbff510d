"""Gradient-boosted trees for binary labels, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited regression trees on the logistic loss (Newton steps, quantile bins)."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least: float = 2.0):
        self.trees, self.depth, self.rate, self.l2, self.least = trees, depth, rate, l2, least
        self.nodes: list[list[tuple]] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.bias = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="lower")) for c in x.T]
        coded = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], 1)  # code <= k: value <= cuts[k]
        f = np.full(len(y), self.bias)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-f))
            tree: list[tuple] = []
            self._grow(tree, coded, cuts, prob - y, np.maximum(prob * (1 - prob), 1e-9), np.arange(len(y)), self.depth, f)
            self.nodes.append(tree)
        return self

    def _grow(self, tree, coded, cuts, g, h, rows, depth, f) -> int:
        at = len(tree)
        tree.append(())
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                code = coded[rows, j]
                gl = np.cumsum(np.bincount(code, g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(code, h[rows], len(c) + 1))[:-1]
                gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                gain[(hl < self.least) | (hs - hl < self.least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        if best[1] is None:
            value = -self.rate * gs / (hs + self.l2)
            tree[at] = (-1, 0.0, 0, 0, value)
            f[rows] += value
        else:
            _, j, k = best
            left = coded[rows, j] <= k
            a = self._grow(tree, coded, cuts, g, h, rows[left], depth - 1, f)
            b = self._grow(tree, coded, cuts, g, h, rows[~left], depth - 1, f)
            tree[at] = (j, float(cuts[j][k]), a, b, 0.0)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        for tree in self.nodes:
            feature = np.array([n[0] for n in tree])
            cut, value = np.array([n[1] for n in tree]), np.array([n[4] for n in tree])
            left, right = np.array([n[2] for n in tree]), np.array([n[3] for n in tree])
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = feature[at]
                down = np.where(x[np.arange(len(x)), np.maximum(j, 0)] <= cut[at], left[at], right[at])
                at = np.where(j < 0, at, down)
            f += value[at]
        return 1 / (1 + np.exp(-f))


def calibrated_threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Lowest threshold whose precision on these held-out rows is reached; above 1 if none."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(y[order])
    good = hits / np.arange(1, len(y) + 1) >= precision
    good &= np.append(score[order][1:] < score[order][:-1], True)  # only between different scores
    return float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 1.1
