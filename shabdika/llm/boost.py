"""Gradient-boosted trees for two classes, small enough to fit on the driver and ship to workers."""

from __future__ import annotations

import numpy as np


class Boost:
    """Logistic boosting of depth-limited trees over binned features. Fitted on a bounded sample; the same data give the same model."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.25, bins: int = 32, least: float = 5.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.cuts: list[np.ndarray] = []
        self.trees: list[list[tuple]] = []
        self.base = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]) if len(self.cuts) else np.zeros((len(x), 0), int)

    def _cuts(self, v: np.ndarray) -> np.ndarray:
        """Between all values where they are few, so that rare ones count too; else at quantiles."""
        u = np.unique(v)
        return u[1:] if len(u) <= self.bins else np.unique(np.quantile(v, np.linspace(0, 1, self.bins + 1)[1:-1]))

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boost":
        """With one class only, the model says that class everywhere; with no rows, one half."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        if not len(y):
            return self
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(p / (1 - p)))
        if y.min() == y.max():
            return self
        self.cuts = [self._cuts(x[:, j]) for j in range(x.shape[1])]
        b = self._bin(x)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p_ = 1 / (1 + np.exp(-f))
            tree: list[tuple] = []
            self._grow(b, y - p_, p_ * (1 - p_), np.arange(len(y)), 0, tree, f)
            self.trees.append(tree)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, level: int, tree: list, f: np.ndarray) -> int:
        me = len(tree)
        tree.append(())
        gs, hs = g[at].sum(), h[at].sum()
        best = (1e-6, -1, -1)
        if level < self.depth and len(at) > 2:
            for j in range(b.shape[1]):
                n = len(self.cuts[j]) + 1
                cg, ch = np.cumsum(np.bincount(b[at, j], g[at], n)), np.cumsum(np.bincount(b[at, j], h[at], n))
                gain = cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1)
                gain[(ch < self.least / 10) | (hs - ch < self.least / 10)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        if best[1] < 0:
            v = self.rate * gs / (hs + 1)
            f[at] += v
            tree[me] = (-1, 0, float(v), 0)
        else:
            left = b[at, best[1]] <= best[2]
            self._grow(b, g, h, at[left], level + 1, tree, f)
            right = self._grow(b, g, h, at[~left], level + 1, tree, f)
            tree[me] = (best[1], best[2], 0.0, right)
        return me

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        x = np.asarray(x, float)
        f = np.full(len(x), self.base)
        if self.trees:
            b = self._bin(x)
            for t in self.trees:
                self._walk(t, 0, b, np.arange(len(x)), f)
        return 1 / (1 + np.exp(-f))

    def _walk(self, t: list, i: int, b: np.ndarray, at: np.ndarray, f: np.ndarray) -> None:
        if not len(at):
            return
        j, k, v, right = t[i]
        if j < 0:
            f[at] += v
            return
        left = b[at, j] <= k
        self._walk(t, i + 1, b, at[left], f)
        self._walk(t, right, b, at[~left], f)
