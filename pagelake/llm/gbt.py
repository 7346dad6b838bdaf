"""Gradient-boosted trees with logistic loss, small and in NumPy.

Trees are complete, of one depth, over features cut into at most 63 bins; the
model is a dict of lists and travels as JSON. Training happens on a bounded
labelled sample; scoring is vectorized over all rows of an Arrow batch.
"""

from __future__ import annotations

import numpy as np


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], side="right")
    return out


def _edges(x: np.ndarray) -> list[np.ndarray]:
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > 64:
            values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 64)))
        cuts.append(((values[1:] + values[:-1]) / 2).astype(np.float32)[:63])
    return cuts


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.2, ridge: float = 2.0, seed: int = 7) -> dict:
    """Fits log-odds of ``y`` (0 or 1); empty ``x`` gives a model that scores 0."""
    x, y = np.asarray(x, np.float32), np.asarray(y, np.float64)
    if not len(y):
        return {"edges": [], "feature": [], "cut": [], "leaf": [], "depth": depth, "base": 0.0}
    rng = np.random.default_rng(seed)
    edges = _edges(x)
    b = _bins(x, edges)
    mean = min(max(y.mean(), 1e-4), 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    score, features, cuts, leaves = np.full(len(y), base), [], [], []
    inner, n_features = 2**depth - 1, x.shape[1]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        rows = np.nonzero(rng.random(len(y)) < 0.7)[0]
        node = np.zeros(len(y), np.int32)
        f_of, c_of = np.zeros(inner, np.int32), np.full(inner, 255, np.int32)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            at = node[rows] - first
            best, best_f, best_c = np.full(n, 1e-6), np.zeros(n, int), np.full(n, 255)
            for j in range(n_features):
                key = at * 64 + b[rows, j]
                gs = np.bincount(key, g[rows], n * 64).reshape(n, 64)
                hs = np.bincount(key, h[rows], n * 64).reshape(n, 64)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                c = gain.argmax(1)
                v = gain[np.arange(n), c]
                up = v > best
                best[up], best_f[up], best_c[up] = v[up], j, c[up]
            f_of[first : first + n], c_of[first : first + n] = best_f, best_c
            at = node - first
            node = 2 * node + 1 + (b[np.arange(len(y)), best_f[at]] > best_c[at])
        leaf = node - inner
        gs, hs = np.bincount(leaf[rows], g[rows], inner + 1), np.bincount(leaf[rows], h[rows], inner + 1)
        value = rate * gs / (hs + ridge)
        score += value[leaf]
        features.append(f_of.tolist()), cuts.append(c_of.tolist()), leaves.append(np.round(value, 4).tolist())
    return {"edges": [np.round(e, 5).tolist() for e in edges], "feature": features, "cut": cuts, "leaf": leaves, "depth": depth, "base": base}


class Model:
    """A trained model ready to score matrices."""

    def __init__(self, model: dict) -> None:
        self.edges = [np.asarray(e, np.float32) for e in model["edges"]]
        self.feature = [np.asarray(f, np.int32) for f in model["feature"]]
        self.cut = [np.asarray(c, np.int32) for c in model["cut"]]
        self.leaf = [np.asarray(v, np.float64) for v in model["leaf"]]
        self.depth, self.base = model["depth"], model["base"]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        if not len(x) or not self.edges:
            return score
        b = np.ascontiguousarray(_bins(np.asarray(x, np.float32), self.edges))
        flat, width, start = b.ravel(), b.shape[1], np.arange(len(x), dtype=np.int64) * b.shape[1]
        del width
        inner = 2**self.depth - 1
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                node = 2 * node + 1 + (flat[start + f[node]] > c[node])
            score += v[node - inner]
        return score
