"""Regression trees on binned features, many small fits as one array program.

A batch holds the rows of many models one after the other. Every tree level is one histogram over
(model, node, feature, bin) and one search for the best cut of each node, so the number of array
operations depends on rounds and depth, not on the models. Nothing a model sees depends on the others
of its batch: rows and features are drawn by the round and the row's place, and sums run in row order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Forest:
    """Per tree, model and inner node (heap order) a feature and a threshold; per leaf a value."""

    start: np.ndarray  # models
    feature: np.ndarray  # trees x models x inner nodes
    above: np.ndarray  # rows with a larger value go right
    leaf: np.ndarray  # trees x models x leaves

    def predict(self, x: np.ndarray) -> np.ndarray:
        """One value for every model's row of ``x`` (models x features)."""
        trees, models, inner = self.feature.shape
        t, m = np.arange(trees)[:, None], np.arange(models)[None, :]
        at, first = np.zeros((trees, models), dtype=np.int64), 0
        while first < inner:
            node = first + at
            at = 2 * at + (x[m, self.feature[t, m, node]] > self.above[t, m, node])
            first = 2 * first + 1
        return self.start + self.leaf[t, m, at].sum(axis=0)


def forest_values(feature: np.ndarray, above: np.ndarray, leaf: np.ndarray, x: np.ndarray, step: int = 2000) -> np.ndarray:
    """The sum of one model's trees (trees x nodes) for every row of ``x``."""
    t, inner, out = np.arange(len(feature))[None, :], feature.shape[1], np.empty(len(x))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        line, at, first = np.arange(len(part))[:, None], np.zeros((len(part), len(feature)), dtype=np.int64), 0
        while first < inner:
            node = first + at
            at = 2 * at + (part[line, feature[t, node]] > above[t, node])
            first = 2 * first + 1
        out[lo : lo + step] = leaf[t, at].sum(axis=1)
    return out


def bin_features(x: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(edges, codes) of one model's features: a code counts the edges below the value."""
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0, method="lower").T
    return edges, np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)


def draws(place: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """A number in [0, 1) for every row and round, the same wherever the row is fitted."""
    z = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((turn * 1_000_003 + seed) % 2**63)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))) / 2.0**64


def best_cuts(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, gain) of the best cut of every node, from sums (nodes x features x bins) of slopes
    and weights; the first best one counts."""
    left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
    all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
    left_g, left_h = left_g[:, :, :-1], left_h[:, :, :-1]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
    gain[(left_h < least) | (right_h < least)] = 0.0
    flat = gain.reshape(len(g), -1)
    pick = flat.argmax(axis=1)
    return pick // gain.shape[2], pick % gain.shape[2], flat[np.arange(len(g)), pick]


def fit_forest(
    x: list[np.ndarray], y: list[np.ndarray], place: list[np.ndarray], kind: str = "gbt", rounds: int = 400, depth: int = 6,
    rate: float = 0.05, rows: float = 0.85, columns: float = 0.85, ridge: float = 1.0, least: float = 1.0, seed: int = 42, bins: int = BINS,
    weights: list[np.ndarray] | None = None,
) -> tuple[Forest, list[np.ndarray]]:
    """Fit one model to each (x, y); returns the models and the fitted values.

    ``gbt``: squared error, each round a tree on the residuals of a share of rows and features.
    ``logistic``: the same for a label 0 or 1, with slopes and curvatures of the log-loss; values are
    log-odds. ``random_forest``: each tree on rows drawn with replacement (Poisson weights), averaged.
    """
    models, width, inner = len(x), x[0].shape[1], 2**depth - 1
    cut = [bin_features(v, bins) for v in x]
    edges = np.stack([np.concatenate([e, np.full((width, 1), np.inf)], axis=1) for e, _ in cut])  # the last cut sends nothing right
    codes, value, where = np.concatenate([c for _, c in cut]), np.concatenate(y), np.concatenate(place)
    model = np.repeat(np.arange(models), [len(v) for v in y])
    line, boosted = np.arange(len(value)), kind != "random_forest"
    given = np.ones(len(value)) if weights is None else np.concatenate(weights)
    if kind not in ("gbt", "logistic", "random_forest"):
        raise ValueError(f"unknown tree model {kind}")
    start = np.bincount(model, value) / np.bincount(model) if kind == "gbt" else np.zeros(models)
    fitted = start[model]
    out = Forest(start, np.zeros((rounds, models, inner), dtype=np.int16), np.full((rounds, models, inner), np.inf), np.zeros((rounds, models, inner + 1)))
    ridge, rate = (ridge, rate) if boosted else (1e-9, 1.0 / rounds)
    for turn in range(rounds):
        luck = draws(where, turn, seed)
        if boosted:
            weight = (luck < rows) * given
            some = np.sort(np.random.default_rng([seed, turn]).permutation(width)[: max(1, round(columns * width))])
        else:  # the inverse distribution of a Poisson draw of mean 1
            weight = np.searchsorted([0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582], luck, side="right") * given
            some = np.arange(width)
        if kind == "logistic":
            p = 1.0 / (1.0 + np.exp(-fitted))
            slope, bend = weight * (p - value), weight * np.maximum(p * (1 - p), 1e-16)
        else:
            slope, bend = weight * (fitted - value if boosted else -value), weight
        at, own = np.zeros(len(value), dtype=np.int64), codes[:, some]
        spread = np.repeat(slope, len(some)), np.repeat(bend, len(some))
        for level in range(depth):
            nodes = 2**level
            cell = (((model * nodes + at) * len(some))[:, None] + np.arange(len(some))[None, :]) * bins + own
            size = models * nodes * len(some) * bins
            g, h = (np.bincount(cell.ravel(), s, size).reshape(-1, len(some), bins) for s in spread)
            feature, border, gain = best_cuts(g, h, ridge, least)
            feature, border = some[feature], np.where(gain > 1e-12, border, bins - 1)
            here = slice(nodes - 1, 2 * nodes - 1)
            out.feature[turn, :, here] = feature.reshape(models, nodes)
            out.above[turn, :, here] = edges[np.repeat(np.arange(models), nodes), feature, border].reshape(models, nodes)
            node = model * nodes + at
            at = 2 * at + (codes[line, feature[node]] > border[node])
        ends = model * (inner + 1) + at
        g, h = (np.bincount(ends, s, models * (inner + 1)) for s in (slope, bend))
        leaf = -rate * g / (h + ridge)
        out.leaf[turn] = leaf.reshape(models, inner + 1)
        fitted = fitted + leaf[ends]
    return out, np.split(fitted, np.cumsum([len(v) for v in y])[:-1])
