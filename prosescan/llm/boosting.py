"""Gradient-boosted trees for two classes on binned features, and isotonic calibration; numpy only."""

from __future__ import annotations

import numpy as np

BINS = 64


class Boosting:
    """Logistic loss, trees grown level by level to a fixed depth, second-order gains."""

    def __init__(self, trees: int = 120, depth: int = 4, rate: float = 0.1, smooth: float = 1.0, least: float = 2.0):
        self.trees, self.depth, self.rate, self.smooth, self.least = trees, depth, rate, smooth, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        if not len(y):
            self.cuts, self.base, self.model = [], 0.0, []
            return self
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        mean = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.model = float(np.log(mean / (1 - mean))), []
        score, n = np.full(len(y), self.base), binned.shape[1]
        for _ in range(self.trees if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(len(y), np.int64)
            features, limits = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                for f in range(n):
                    slot = node * BINS + binned[:, f]
                    gs = np.bincount(slot, g, width * BINS).reshape(width, BINS).cumsum(1)
                    hs = np.bincount(slot, h, width * BINS).reshape(width, BINS).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + self.smooth) + (gt - gl) ** 2 / (ht - hl + self.smooth) - gt**2 / (ht + self.smooth)
                    gain = np.where((hl < self.least) | (ht - hl < self.least), 0, gain)
                    at = gain.argmax(1)
                    value = gain[np.arange(width), at]
                    better = value > best
                    best[better] = value[better]
                    features[first : first + width][better], limits[first : first + width][better] = f, at[better]
                f = features[first + node]
                node = 2 * node + ((f >= 0) & (binned[np.arange(len(y)), np.maximum(f, 0)] > limits[first + node]))
            leaf = -self.rate * np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.smooth)
            self.model.append((features, limits, leaf))
            score += leaf[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        score = np.full(len(x), self.base)
        if not len(x) or not self.model:
            return score
        binned = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        rows = np.arange(len(x))
        for features, limits, leaf in self.model:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                f = features[at]
                node = 2 * node + ((f >= 0) & (binned[rows, np.maximum(f, 0)] > limits[at]))
            score += leaf[node]
        return score


class Isotonic:
    """Margins to probabilities: pooled adjacent violators, joined by lines, with a slight slope so that order is kept."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(margin, kind="stable")
        pools: list[list[float]] = []
        for m, v in zip(np.asarray(margin, float)[order], np.asarray(y, float)[order], strict=True):
            pools.append([m, v, 1.0])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                m2, v2, n2 = pools.pop()
                m1, v1, n1 = pools.pop()
                pools.append([(m1 * n1 + m2 * n2) / (n1 + n2), v1 + v2, n1 + n2])
        self.at = np.array([p[0] for p in pools])
        self.share = np.array([(p[1] + 0.05) / (p[2] + 0.1) for p in pools])
        self.share = np.maximum.accumulate(self.share) if len(pools) else self.share
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        slope = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return slope if not len(self.at) else 0.999 * np.interp(margin, self.at, self.share) + 0.001 * slope
