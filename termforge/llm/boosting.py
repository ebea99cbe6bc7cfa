"""Gradient-boosted trees for yes/no labels, in numpy: logistic loss, Newton leaves, binned features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of `depth` levels over features cut at quantiles of the training rows."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            for level in range(self.depth):
                width, first = 1 << level, (1 << level) - 1
                best = np.zeros(width)
                at = np.zeros(width, np.int64)
                for f in range(x.shape[1]):
                    size = width * (self.bins + 1)
                    sg = np.bincount(node * (self.bins + 1) + binned[:, f], g, size).reshape(width, -1).cumsum(1)
                    sh = np.bincount(node * (self.bins + 1) + binned[:, f], h, size).reshape(width, -1).cumsum(1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + self.ridge) + (tg - sg) ** 2 / (th - sh + self.ridge) - tg**2 / (th + self.ridge)
                    gain = gain[:, : len(edges[f])]
                    if gain.shape[1]:
                        k = gain.argmax(1)
                        value = gain[np.arange(width), k]
                        better = value > best + 1e-9
                        best[better], at[better] = value[better], k[better]
                        feature[first : first + width][better] = f
                        cut[first : first + width][better] = edges[f][k[better]]
                right = x[np.arange(len(y)), feature[first + node]] > cut[first + node]
                node = node * 2 + right
            leaves = 1 << self.depth
            value = np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge) * self.rate
            score += value[node]
            self.trees.append((feature, cut, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of yes."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            total += value[node]
        return 1 / (1 + np.exp(-total))


def threshold_for(scores: np.ndarray, labels: np.ndarray, precision: float = 0.98) -> float:
    """The least score from which on the share of right answers is at least `precision`; 1.01 if there is none."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(labels[order]) / np.arange(1, len(order) + 1)
    last = np.flatnonzero((right >= precision) & (np.append(np.diff(scores[order]), -1) < 0))
    return float(scores[order][last[-1]]) if len(last) else 1.01
