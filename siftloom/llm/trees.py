"""Small learners in numpy: histogram gradient boosting, isotonic regression and quantile bins."""

from __future__ import annotations

import numpy as np


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per feature, up to bins - 1 distinct quantiles."""
    at = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, j], at, method="lower")) for j in range(x.shape[1])]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin b holds edges[b-1] < x <= edges[b]."""
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.int64)


class BoostedTrees:
    """Log-loss boosting of depth-limited trees on binned features, Newton leaves."""

    def __init__(self, base: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int):
        self.base, self.trees, self.depth = base, trees, depth

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: float = 4.0, seed: int = 7) -> BoostedTrees:
        edges = bin_edges(x, bins)
        b = to_bins(x, edges)
        n, d = b.shape
        flat = b + np.arange(d) * bins
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        base = float(np.log(p / (1 - p)))
        f = np.full(n, base)
        trees = []
        rng = np.random.default_rng(seed)
        for _ in range(rounds):
            prob = 1 / (1 + np.exp(-f))
            g, h = (y - prob), prob * (1 - prob)
            use = rng.random(n) < 0.8
            feature = np.zeros(2**depth - 1, np.int64)
            cut = np.full(2**depth - 1, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                width = 2**level
                size = width * d * bins
                index = (node[use, None] * (d * bins) + flat[use]).ravel()
                gs = np.bincount(index, np.repeat(g[use], d), size).reshape(width, d, bins).cumsum(axis=2)
                hs = np.bincount(index, np.repeat(h[use], d), size).reshape(width, d, bins).cumsum(axis=2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least / 4) | (ht - hs < least / 4)] = 0
                best = gain.reshape(width, -1).argmax(axis=1)
                value = gain.reshape(width, -1).max(axis=1)
                j, k = best // bins, best % bins
                good = value > 1e-9
                threshold = np.array([edges[a][c] if ok and c < len(edges[a]) else np.inf for a, c, ok in zip(j, k, good, strict=True)])
                feature[width - 1 : 2 * width - 1], cut[width - 1 : 2 * width - 1] = np.where(good, j, 0), threshold
                node = node * 2 + (x[np.arange(n), feature[width - 1 + node]] > cut[width - 1 + node])
            gl = np.bincount(node[use], g[use], 2**depth)
            hl = np.bincount(node[use], h[use], 2**depth)
            leaf = rate * gl / (hl + l2)
            f += leaf[node]
            trees.append((feature, cut, leaf))
        return cls(base, trees, depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            f += leaf[node]
        return f


def isotonic_fit(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators, one row of either class added as a prior; knots for linear interpolation."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, lowest, highest
    for v, t in zip(raw[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(v), float(v)])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            m, w, _, hi = blocks.pop()
            p = blocks[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, hi
    xs, ys = [], []
    for m, w, lo, hi in blocks:
        value = (m * w + 0.02) / (w + 0.1) if w < 1e9 else m
        xs += [lo, hi] if hi > lo else [lo]
        ys += [value, value] if hi > lo else [value]
    return np.array(xs), np.maximum.accumulate(np.array(ys))
