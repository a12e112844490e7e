"""Small fits on the driver, over bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def hashed_sample(df: DataFrame, key, rows: int, seed: int) -> DataFrame:
    """About rows rows of df, those whose hashed key is lowest in the scale of its count; all where it has fewer."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def newton_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic fit of a few columns, by damped Newton steps on standardised columns."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-12, scale, 1)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), l2 * 1.0)
    penalty[-1] = 1e-6
    loss = lambda v: np.logaddexp(0, -np.where(y > 0, 1, -1) * (z @ v)).sum() + 0.5 * (penalty * v * v).sum()
    for _ in range(rounds):
        p = sigmoid(z @ w)
        slope = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), slope)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


class Boosted:
    """Boosted regression trees on the logistic loss, of a few rows: splits by sorted cuts, leaves by one Newton step."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, least: float = 3.0):
        self.depth, self.rate, self.trees = depth, rate, []
        rate_of = (weight @ y + 1) / (weight.sum() + 2)
        self.start = float(np.log(rate_of / (1 - rate_of)))
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 18)[1:-1], method="lower")) for k in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
        score = np.full(len(y), self.start)
        for _ in range(trees):
            p = sigmoid(score)
            slope, curve = weight * (y - p), weight * p * (1 - p)
            size = 1 << depth
            feature, cut, leaf, place = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size), np.ones(len(y), np.int64)
            for node in range(1, size):
                rows = np.flatnonzero(place == node)
                best, g, h = (1e-3, None, 0), slope[rows].sum(), curve[rows].sum()
                for k in range(x.shape[1]) if len(rows) > 1 else ():
                    n = len(cuts[k]) + 1
                    left = np.bincount(bins[rows, k], slope[rows], n).cumsum()[:-1]
                    mass = np.bincount(bins[rows, k], curve[rows], n).cumsum()[:-1]
                    much = np.bincount(bins[rows, k], weight[rows], n).cumsum()[:-1]
                    gain = left**2 / (mass + 1) + (g - left) ** 2 / (h - mass + 1) - g**2 / (h + 1)
                    gain[(much < least) | (weight[rows].sum() - much < least)] = 0
                    j = int(gain.argmax()) if len(gain) else 0
                    if len(gain) and gain[j] > best[0]:
                        best = (gain[j], k, j)
                if best[1] is not None:
                    feature[node], cut[node] = best[1], cuts[best[1]][best[2]]
                place[rows] = 2 * node + (x[rows, feature[node]] > cut[node])
            leaf = np.bincount(place - size, slope, size) / (np.bincount(place - size, curve, size) + 1)
            score += rate * leaf[place - size]
            self.trees.append((feature, cut, leaf))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1."""
        out, size = np.full(len(x), self.start), 1 << self.depth
        for feature, cut, leaf in self.trees:
            place = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                place = 2 * place + (x[np.arange(len(x)), feature[place]] > cut[place])
            out += self.rate * leaf[place - size]
        return out
