"""Boosted trees for two classes over binned features, with calibrated thresholds: small models fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Gradient boosting of the logistic loss. A tree is complete: level by level each node takes the split of the greatest gain, and a
    node without one sends all to the left. edges[f] are the bins' edges of a feature; a value belongs to the first bin that ends above it."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 4.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros(x.shape, dtype=np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned, n, width = self._binned(x), len(x), self.bins + 1
        share = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(n, self.start)
        places = np.arange(x.shape[1]) * width + binned
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            gradient, curve = y - p, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(n, dtype=np.int64)
            features, cuts = np.zeros(2**self.depth - 1, dtype=np.int64), np.full(2**self.depth - 1, width, dtype=np.int64)
            for level in range(self.depth):
                nodes, base = 2**level, 2**level - 1
                cells = x.shape[1] * width
                at = (node[:, None] * cells + places).ravel()
                g = np.bincount(at, np.repeat(gradient, x.shape[1]), nodes * cells).reshape(nodes, x.shape[1], width).cumsum(axis=2)
                h = np.bincount(at, np.repeat(curve, x.shape[1]), nodes * cells).reshape(nodes, x.shape[1], width).cumsum(axis=2)
                whole_g, whole_h = g[:, :, -1:], h[:, :, -1:]
                score = lambda a, b: a * a / (b + self.ridge)
                gain = score(g, h) + score(whole_g - g, whole_h - h) - score(whole_g, whole_h)
                gain[(h < self.least) | (whole_h - h < self.least)] = 0
                best = gain.reshape(nodes, -1).argmax(axis=1)
                useful = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
                features[base : base + nodes] = np.where(useful, best // width, 0)
                cuts[base : base + nodes] = np.where(useful, best % width, width)
                node = 2 * node + (binned[np.arange(n), features[base + node]] > cuts[base + node])
            g, h = np.bincount(node, gradient, 2**self.depth), np.bincount(node, curve, 2**self.depth)
            leaves = self.rate * g / (h + self.ridge)
            self.trees.append((features, cuts, leaves))
            margin += leaves[node]
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The log-odds before calibration."""
        out, binned, rows = np.full(len(x), self.start), self._binned(x), np.arange(len(x))
        for features, cuts, leaves in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (binned[rows, features[at]] > cuts[at])
            out += leaves[node]
        return out


def isotonic(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margins, probabilities), both rising: the nearest rising steps to the outcomes, by pooling neighbours that fall."""
    order = np.argsort(margins, kind="stable")
    steps: list[list[float]] = []  # sum, count, least margin
    for m, v in zip(margins[order].tolist(), y[order].tolist(), strict=True):
        if steps and steps[-1][3] == m:
            steps[-1][0] += v
            steps[-1][1] += 1
        else:
            steps.append([v, 1, m, m])
        while len(steps) > 1 and steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1]:
            last = steps.pop()
            steps[-1][0] += last[0]
            steps[-1][1] += last[1]
            steps[-1][3] = last[3]
    return np.array([s[2] for s in steps]), np.array([s[0] / s[1] for s in steps])


def probability(curve: tuple[np.ndarray, np.ndarray], margins: np.ndarray) -> np.ndarray:
    at = np.searchsorted(curve[0], margins, side="right") - 1
    return np.where(at < 0, 0.0, curve[1][np.maximum(at, 0)])


def threshold(chances: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least calibrated probability from which on held-out rows have that precision; above 1 if none has."""
    best = 1.1
    for t in np.unique(chances)[::-1]:
        if y[chances >= t].mean() >= precision:
            best = float(t)
    return best
