"""Gradient-boosted trees with logistic loss on binned features."""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete binary trees of one depth; feature and bin of every inner node, value of every leaf."""

    def __init__(self, edges: list[np.ndarray], bias: float, depth: int):
        self.edges, self.bias, self.depth = edges, bias, depth
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.value: list[np.ndarray] = []

    def document(self) -> dict:
        """All numbers of the model, for JSON."""
        return {"bias": self.bias, "depth": self.depth, "feature": [f.tolist() for f in self.feature], "cut": [c.tolist() for c in self.cut], "value": [v.tolist() for v in self.value]}

    @classmethod
    def read(cls, document: dict, edges: list[np.ndarray]) -> Trees:
        out = cls(edges, document["bias"], document["depth"])
        out.feature, out.cut = ([np.array(x) for x in document[k]] for k in ("feature", "cut"))
        out.value = [np.array(x) for x in document["value"]]
        return out

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def leaf(self, bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
        return node - (2**self.depth - 1)

    def logit(self, bins: np.ndarray) -> np.ndarray:
        """Log odds of rows of ``binned`` features."""
        out = np.full(len(bins), self.bias)
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            out += v[self.leaf(bins, f, c)]
        return out


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 5, rate: float = 0.25, n_bins: int = 24, ridge: float = 2.0) -> Trees:
    """Trees for P(y); every split takes the largest gain over all features and bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1]).round(6)) for j in range(x.shape[1])]
    mean = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    model = Trees(edges, round(float(np.log(mean / (1 - mean))), 6), depth)
    bins, n, d = model.binned(x), len(x), x.shape[1]
    flat = bins.astype(np.int64) + np.arange(d) * n_bins
    logit = np.full(n, model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        grad, hess = weight * (y - p), weight * p * (1 - p) + 1e-9
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 255, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, base = 2**level, 2**level - 1
            at = ((node - base)[:, None] * (d * n_bins) + flat).ravel()
            g = np.bincount(at, np.repeat(grad, d), width * d * n_bins).reshape(width, d, n_bins)
            h = np.bincount(at, np.repeat(hess, d), width * d * n_bins).reshape(width, d, n_bins)
            gl, hl = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
            gt, ht = g.sum(2)[:, :, None], h.sum(2)[:, :, None]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            best = gain.reshape(width, -1).argmax(1)
            top = gain.reshape(width, -1)[np.arange(width), best]
            own = base + np.arange(width)
            feature[own], cut[own] = best // (n_bins - 1), np.where(top > 1e-6, best % (n_bins - 1), 255)
            node = 2 * node + 1 + (bins[np.arange(n), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = (rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + ridge)).round(6)
        logit += value[leaf]
        model.feature.append(feature)
        model.cut.append(cut)
        model.value.append(value)
    return model
