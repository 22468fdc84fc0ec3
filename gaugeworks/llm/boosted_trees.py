"""Gradient-boosted trees for a yes/no label, fitted on a bounded table of numbers."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of one depth: a split (feature, threshold) per inner node, a value per leaf."""

    def __init__(self, start: float, features: np.ndarray, cuts: np.ndarray, leaves: np.ndarray):
        self.start, self.features, self.cuts, self.leaves = start, features, cuts, leaves

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - inner]
        return 1.0 / (1.0 + np.exp(-total))


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0
) -> BoostedTrees:
    """Logistic loss, second-order leaf values, splits on quantile bins."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    score, inner = np.full(n, start), 2**depth - 1
    features, cuts, leaves = [], [], []
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-score))
        slope, bend = p - y, p * (1 - p)
        feature, cut, at = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best, split = np.full(nodes, 1e-6), [None] * nodes
            for j in range(width):
                key = (at - first) * bins + binned[:, j]
                g = np.bincount(key, slope, nodes * bins).reshape(nodes, bins).cumsum(axis=1)
                h = np.bincount(key, bend, nodes * bins).reshape(nodes, bins).cumsum(axis=1)
                left, right = g[:, :-1], g[:, -1:] - g[:, :-1]
                gain = left**2 / (h[:, :-1] + ridge) + right**2 / (h[:, -1:] - h[:, :-1] + ridge)
                gain -= g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain = gain[:, : len(edges[j])]
                for node in range(nodes if gain.shape[1] else 0):
                    b = int(gain[node].argmax())
                    if gain[node, b] > best[node]:
                        best[node], split[node] = gain[node, b], (j, edges[j][b])
            for node, s in enumerate(split):
                if s is not None:
                    feature[first + node], cut[first + node] = s
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        g, h = np.bincount(at - inner, slope, inner + 1), np.bincount(at - inner, bend, inner + 1)
        leaf = -rate * g / (h + ridge)
        score = score + leaf[at - inner]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return BoostedTrees(start, np.array(features), np.array(cuts), np.array(leaves))
