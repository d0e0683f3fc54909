"""Gradient-boosted trees for two classes and isotonic calibration, in numpy, for samples that fit the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of a fixed depth as arrays: node i has children 2i+1, 2i+2."""

    depth: int = 3
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**self.depth - 1)]
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 1.0, penalty: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss over quantile histograms."""
    n, m = x.shape
    model = Boosted(depth)
    p0 = min(max(float(y.mean()) if n else 0.0, 1e-3), 1 - 1e-3)
    model.base = float(np.log(p0 / (1 - p0)))
    if not n or y.min() == y.max():
        return model
    edges = []
    code = np.zeros((n, m), np.int64)
    for j in range(m):
        # values between the zeros and the rest keep their own cuts, however many rows are zero
        u = np.unique(x[:, j])
        q = np.unique(np.quantile(u, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(u) > bins else u[:-1]
        edges.append(q)
        code[:, j] = np.searchsorted(q, x[:, j], "left")
    width = bins + 1
    flat = code + np.arange(m) * width
    score = np.full(n, model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            begin = 2**level - 1
            k = node - begin
            key = (k[:, None] * m * width + flat).ravel()
            size = 2**level * m * width
            gs = np.bincount(key, np.repeat(g, m), size).reshape(2**level, m, width).cumsum(2)
            hs = np.bincount(key, np.repeat(h, m), size).reshape(2**level, m, width).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + penalty) + (gt - gs) ** 2 / (ht - hs + penalty) - gt**2 / (ht + penalty)
            gain[(hs < least) | (ht - hs < least)] = 0
            best = gain.reshape(2**level, -1)
            at = best.argmax(1)
            for b in range(2**level):
                if best[b, at[b]] > 1e-6:
                    j, c = divmod(int(at[b]), width)
                    if c < len(edges[j]):
                        feature[begin + b], cut[begin + b] = j, edges[j][c]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        k = node - inner
        value = rate * np.bincount(k, g, inner + 1) / (np.bincount(k, h, inner + 1) + penalty)
        score += value[k]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(value)
    return model


@dataclass
class Isotonic:
    """A non-decreasing map of raw scores to probabilities, linear between its knots."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool-adjacent-violators; equal raw scores share one value."""
    if not len(raw):
        return Isotonic(np.zeros(1), np.zeros(1))
    u, inv = np.unique(raw, return_inverse=True)
    weight = np.bincount(inv).astype(float)
    mean = np.bincount(inv, y) / weight
    blocks: list[list[float]] = []  # mean, weight, first, last
    for i in range(len(u)):
        blocks.append([mean[i], weight[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
    xs, ys = [], []
    for v, _, a, b in blocks:
        for k in dict.fromkeys((int(a), int(b))):
            xs.append(u[k])
            ys.append(v)
    return Isotonic(np.array(xs), np.array(ys))
