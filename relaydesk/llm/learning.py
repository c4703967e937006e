"""Folds, bounded samples and small numpy models shared by the learned operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the held-out fold; a null id never does."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def seeded_first(rows: DataFrame, n: int, id_col: str, seed: int) -> DataFrame:
    """At most ``n`` rows, those first by hash of seed and id: a sample that reruns repeat."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), F.col(id_col)).limit(n)


def seeded_few(rows: DataFrame, n: int, id_col: str, seed: int) -> DataFrame:
    """The same rows, for a sample that is collected: all but about ``n`` are left out by their hash alone,
    so what tasks send to order them does not grow with their number."""
    total, spare = rows.count(), 6 * int(n**0.5) + 50
    while total > 2 * (n + spare):
        most = min(-(1 << 63) + (1 << 64) * (n + spare) // total, (1 << 63) - 1)
        first = rows.where(F.xxhash64(F.lit(seed), F.col(id_col)) <= most)
        if first.count() >= n:
            return seeded_first(first, n, id_col, seed)
        spare = 2 * spare + n  # chance, or much repeated ids
    return seeded_first(rows, n, id_col, seed)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Scaler:
    """Columns to zero mean and unit spread, clipped at ``clip`` spreads."""

    def __init__(self, x: np.ndarray, clip: float = 6.0):
        self.mean, self.spread, self.clip = x.mean(0), x.std(0) + 1e-6, clip

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -self.clip, self.clip)


class Net:
    """One hidden layer of tanh units and a linear output, trained by Adam on a gradient of the outputs."""

    def __init__(self, width: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.weights = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def hidden(self, x):
        return np.tanh(x @ self.weights[0] + self.weights[1])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.weights[2] + self.weights[3][0]

    def fit(self, batches, output_gradient, rate: float = 0.01, decay: float = 1e-3):
        """``batches`` yields what ``output_gradient(net, batch)`` turns into (inputs, gradient per output)."""
        moment = [np.zeros_like(w) for w in self.weights]
        square = [np.zeros_like(w) for w in self.weights]
        for step, batch in enumerate(batches, 1):
            x, g = output_gradient(self, batch)
            h = self.hidden(x)
            back = np.outer(g, self.weights[2]) * (1 - h * h)
            grads = [x.T @ back + decay * self.weights[0], back.sum(0), h.T @ g + decay * self.weights[2], np.array([g.sum()])]
            for w, grad, m, s in zip(self.weights, grads, moment, square):
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self


def minibatches(n: int, size: int, epochs: int, rng: np.random.Generator):
    for _ in range(epochs):
        order = rng.permutation(n)
        for first in range(0, n, size):
            yield order[first : first + size]


def logistic(x: np.ndarray, y: np.ndarray, hidden: int = 8, epochs: int = 60, seed: int = 42, batch: int = 512) -> Net:
    """A net fitted to labels by cross-entropy."""
    net, rng = Net(x.shape[1], hidden, seed), np.random.default_rng(seed)
    return net.fit(minibatches(len(x), batch, epochs, rng), lambda m, k: (x[k], (sigmoid(m(x[k])) - y[k]) / len(k)))
