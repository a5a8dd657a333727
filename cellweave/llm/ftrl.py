"""FTRL-proximal logistic regression over sparse hashed features, trained on shards whose weights are averaged."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """Rows of features: ``row``, ``key`` and ``value`` in step, sorted by row; ``n`` rows."""

    row: np.ndarray
    key: np.ndarray
    value: np.ndarray
    n: int


@dataclass
class Weights:
    """The features with a weight, sorted by key, and the intercept."""

    key: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, x: Sparse) -> np.ndarray:
        """Probability of label 1 for each row; a row without known features gets the intercept's."""
        total = np.full(x.n, self.bias)
        if len(self.key) and len(x.key):
            # a small table of low bits turns away nearly all features before the search
            maybe = np.zeros(1 << 16, bool)
            maybe[(self.key & np.uint64(0xFFFF)).astype(np.int64)] = True
            hit = np.flatnonzero(maybe[(x.key & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.key, x.key[hit]), len(self.key) - 1)
            same = self.key[at] == x.key[hit]
            total += np.bincount(x.row[hit][same], self.weight[at[same]] * x.value[hit][same], x.n)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: Sparse, y: np.ndarray, *, epochs: int, alpha: float, beta: float, l1: float, l2: float, least_rows: int, common: float | None = None, seed: int = 7) -> Weights:
    """Follow-the-regularised-leader with per-coordinate rates; L1 keeps most weights at exactly zero.

    y may be a probability. A feature that fewer than ``least_rows`` rows have is left out. The intercept isn't penalised.
    With ``common``, a feature that a share s of the rows has counts max(0, -ln s - common) times; the weights returned
    include that factor.
    """
    key, index, count = np.unique(x.key, return_inverse=True, return_counts=True)
    rarity = np.ones(len(key)) if common is None else np.maximum(0, np.log(x.n / count) - common)
    kept = np.flatnonzero((count >= least_rows) & (rarity > 0))
    place = np.full(len(key), -1)
    place[kept] = np.arange(len(kept))
    use = place[index] >= 0
    row, value = x.row[use], x.value[use] * rarity[index[use]]
    index = place[index[use]]
    bounds = np.searchsorted(row, np.arange(x.n + 1))
    z, n = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    penalty = np.full(len(kept) + 1, l1)
    penalty[-1] = 0

    def weights(at):
        big = np.abs(z[at]) > penalty[at]
        return np.where(big, -(z[at] - np.sign(z[at]) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(x.n):
            part = slice(bounds[r], bounds[r + 1])
            at = np.append(index[part], len(kept))
            v = np.append(value[part], 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -30, 30))) - y[r]) * v
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(len(kept) + 1))
    some = np.flatnonzero(w[:-1])
    return Weights(key[kept][some], (w[:-1] * rarity[kept])[some], float(w[-1]))
