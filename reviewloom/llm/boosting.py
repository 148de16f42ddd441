"""Small gradient-boosted trees for tables of a few thousand rows."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of trees of fixed depth on binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32) -> None:
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-margin))
            grad, hess = y - prob, prob * (1 - prob)
            inner = (1 << self.depth) - 1
            feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(1 << self.depth)
            node = np.zeros(len(y), np.int64)
            for place in range(inner):
                own = node == place
                if own.sum() > 1:
                    feature[place], cut[place] = self._split(binned[own], grad[own], hess[own], cuts)
                node[own] = 2 * place + 1 + (x[own, feature[place]] > cut[place])
            for i in range(1 << self.depth):
                own = node == inner + i
                leaf[i] = self.rate * grad[own].sum() / (hess[own].sum() + 1.0)
            margin += leaf[node - inner]
            self.trees.append((feature, cut, leaf))
        return self

    def _split(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float]:
        best, at = 1e-9, (0, np.inf)
        whole_g, whole_h = grad.sum(), hess.sum()
        for f, q in enumerate(cuts):
            g = np.bincount(binned[:, f], grad, len(q) + 1).cumsum()[:-1]
            h = np.bincount(binned[:, f], hess, len(q) + 1).cumsum()[:-1]
            if len(g):
                gain = g**2 / (h + 1) + (whole_g - g) ** 2 / (whole_h - h + 1) - whole_g**2 / (whole_h + 1)
                if gain.max() > best:
                    best, at = gain.max(), (f, float(q[gain.argmax()]))
        return at

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin, every = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[every, feature[node]] > cut[node])
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-margin))
