"""Gradient-boosted trees on binned features, small enough to travel with a task.

Fitting runs on a bounded sample on the driver; scoring is numpy over the rows of a batch.
"""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Binary log-loss boosting.  Trees are complete to ``depth``; a node without a useful split sends
    every row left."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.3, ridge: float = 2.0, least: int = 10):
        self.trees, self.depth, self.rate, self.ridge, self.least = trees, depth, rate, ridge, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
        b = self._binned(x)
        n, features = b.shape
        share = np.clip(y.mean(), 0.001, 0.999)
        self.start = float(np.log(share / (1 - share)))
        odds = np.full(n, self.start)
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), BINS, np.int64)
        self.value = np.zeros((self.trees, 1 << self.depth))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-odds))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, here = (1 << level) - 1, 1 << level
                best = np.full(here, 1e-6)
                for f in range(features):
                    slot = (node - first) * BINS + b[:, f]
                    g, h, c = (np.bincount(slot, w, here * BINS).reshape(here, BINS).cumsum(axis=1) for w in (grad, hess, None))
                    gain = (g ** 2 / (h + self.ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.ridge)
                            - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge))
                    gain[(c < self.least) | (c[:, -1:] - c < self.least)] = 0
                    at = gain.argmax(axis=1)
                    better = gain[np.arange(here), at] > best
                    best[better] = gain[np.arange(here), at][better]
                    self.feature[t, first:first + here][better] = f
                    self.cut[t, first:first + here][better] = at[better]
                node = 2 * node + 1 + (b[np.arange(n), self.feature[t, node]] > self.cut[t, node])
            leaf = node - inner
            g, h = np.bincount(leaf, grad, 1 << self.depth), np.bincount(leaf, hess, 1 << self.depth)
            self.value[t] = self.rate * g / (h + self.ridge)
            odds += self.value[t, leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        rows = np.arange(len(b))
        out = np.full(len(b), self.start)
        for t in range(self.trees):
            node = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, self.feature[t, node]] > self.cut[t, node])
            out += self.value[t, node - ((1 << self.depth) - 1)]
        return out
