"""Boosted regression trees for a two-class target, over binned numeric features, in numpy. Small by design: the sample that it is fitted on is bounded."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    start: float
    feature: np.ndarray  # tree x inner node
    cut: np.ndarray  # value above which a row goes right
    leaf: np.ndarray  # tree x leaf
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of the positive class, by row."""
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            score += v[node - ((1 << self.depth) - 1)]
        return 1 / (1 + np.exp(-score))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Newton boosting on the log loss; the cuts of a feature are quantiles of its values."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # bin <= k: value <= cuts[k]
    rate_of_one = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    start = float(np.log(rate_of_one / (1 - rate_of_one)))
    score = np.full(n, start)
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, cut, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            width, base = 1 << level, (1 << level) - 1
            local = node - base
            best = np.full(width, 1e-9)
            g_all, h_all = np.bincount(local, g, width), np.bincount(local, h, width)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                k = len(c) + 1
                at = local * k + binned[:, j]
                gl = np.bincount(at, g, width * k).reshape(width, k).cumsum(1)[:, :-1]
                hl = np.bincount(at, h, width * k).reshape(width, k).cumsum(1)[:, :-1]
                gr, hr = g_all[:, None] - gl, h_all[:, None] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g_all**2 / (h_all + ridge))[:, None]
                gain[(hl < 1e-3) | (hr < 1e-3)] = 0
                top = gain.argmax(1)
                for w in np.flatnonzero(gain[np.arange(width), top] > best):
                    best[w] = gain[w, top[w]]
                    feature[t, base + w], cut[t, base + w] = j, c[top[w]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        end = node - inner
        leaf[t] = rate * np.bincount(end, g, leaves) / (np.bincount(end, h, leaves) + ridge)
        score += leaf[t][end]
    return Boosted(start, feature, cut, leaf, depth)
