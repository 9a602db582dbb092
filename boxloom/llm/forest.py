"""A random forest of binary classification trees, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Forest(NamedTuple):
    feature: np.ndarray  # trees by nodes; -1 at a leaf
    threshold: np.ndarray
    child: np.ndarray  # of values up to the threshold; the other one follows it
    share: np.ndarray  # of positive rows

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, child, share in zip(*self):
            node = np.zeros(len(x), int)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > threshold[node]
                node = np.where(inner, child[node] + right, node)
            total += share[node]
        return total / len(self.feature)


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int) -> tuple[float, int, float]:
    """Gain, feature and threshold of the best Gini split."""
    n, best = len(y), (0.0, -1, 0.0)
    gini = lambda p, m: m - (p * p + (m - p) * (m - p)) / m
    whole = gini(y.sum(), n)
    k = np.arange(1, n)
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        left = np.cumsum(y[order])[:-1]
        gain = whole - gini(left, k) - gini(y.sum() - left, n - k)
        gain[(v[1:] == v[:-1]) | (k < least) | (n - k < least)] = 0
        if len(gain) and gain.max() > best[0] + 1e-9:
            i = int(gain.argmax())
            best = float(gain[i]), int(f), float((v[i] + v[i + 1]) / 2)
    return best


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 0) -> Forest:
    """Bootstrapped rows for each tree, the square root of all features drawn for each split."""
    rng = np.random.default_rng(seed)
    y = np.asarray(y, float)
    tries = max(1, round(x.shape[1] ** 0.5))
    grown = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
        todo = [(0, rows, 0)]
        while todo:
            at, rows, level = todo.pop()
            nodes[at][3] = float(y[rows].mean()) if len(rows) else 0.0
            if level == depth or len(rows) < 2 * least or nodes[at][3] in (0.0, 1.0):
                continue
            _, f, t = _split(x[rows], y[rows], rng.choice(x.shape[1], tries, replace=False), least)
            if f < 0:
                continue
            nodes[at][:3] = [f, t, len(nodes)]
            right = x[rows, f] > t
            todo += [(len(nodes), rows[~right], level + 1), (len(nodes) + 1, rows[right], level + 1)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        grown.append(np.array(nodes))
    most = max(map(len, grown))
    full = np.stack([np.pad(g, ((0, most - len(g)), (0, 0)), constant_values=-1) for g in grown])
    return Forest(full[..., 0].astype(int), full[..., 1], full[..., 2].astype(int), full[..., 3])
