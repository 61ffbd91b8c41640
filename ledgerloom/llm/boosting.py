"""Gradient-boosted trees for a yes-or-no question, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Forest:
    """Complete trees: in each node a feature and a limit (go right above it), in each leaf a value."""

    features: np.ndarray
    limits: np.ndarray
    leaves: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1]))
        for feature, limit, leaf in zip(self.features, self.limits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], lam: float) -> tuple[int, float]:
    """The feature and limit of the greatest gain; (0, inf) if none gains."""
    best, where = 1e-6, (0, np.inf)
    total_g, total_h = g.sum(), h.sum()
    for f, limits in enumerate(edges):
        if not len(limits) or not len(x):
            continue
        bins = np.searchsorted(limits, x[:, f], "left")
        left_g = np.cumsum(np.bincount(bins, g, len(limits) + 1))[:-1]
        left_h = np.cumsum(np.bincount(bins, h, len(limits) + 1))[:-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g**2 / (left_h + lam) + right_g**2 / (right_h + lam) - total_g**2 / (total_h + lam)
        gain[(left_h < 1) | (right_h < 1)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, where = gain[k], (f, float(limits[k]))
    return where


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, lam: float = 1.0) -> Forest:
    """Newton boosting of the log loss over quantile bins."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    nodes, leaves = 2**depth - 1, 2**depth
    forest = Forest(np.zeros((0, nodes), int), np.zeros((0, nodes)), np.zeros((0, leaves)), float(np.log(share / (1 - share))))
    z = np.full(len(y), forest.base)
    made = []
    for _ in range(trees):
        p = sigmoid(z)
        g, h = p - y, p * (1 - p)
        feature, limit, leaf = np.zeros(nodes, int), np.full(nodes, np.inf), np.zeros(leaves)
        at = np.zeros(len(y), np.int64)
        for k in range(nodes):
            own = np.flatnonzero(at == k)
            feature[k], limit[k] = _split(x[own], g[own], h[own], edges, lam)
            at[own] = 2 * k + 1 + (x[own, feature[k]] > limit[k])
        for k in range(leaves):
            own = at == nodes + k
            leaf[k] = -rate * g[own].sum() / (h[own].sum() + lam)
        z += leaf[at - nodes]
        made.append((feature, limit, leaf))
    features, limits, values = (np.array(c) for c in zip(*made, strict=True))
    return Forest(features, limits, values, forest.base)


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Platt's slope and shift for raw scores, by gradient descent with smoothed targets."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    scale = max(1e-6, float(z.std()))
    a, b = 1.0, 0.0
    for _ in range(steps):
        d = sigmoid(a * z / scale + b) - target
        a -= 0.5 * float((d * z / scale).mean())
        b -= 0.5 * float(d.mean())
    return a / scale, b
