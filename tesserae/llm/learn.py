"""Small models trained on the driver from bounded samples and carried to the tasks as arrays of fixed size."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from zlib import crc32

import numpy as np

BITS = 18
MASK = (1 << BITS) - 1


def hashed(features: Iterable[str]) -> list[int]:
    return [crc32(f.encode("utf-8", "surrogatepass")) & MASK for f in features]


def fit_logistic(rows: Sequence[Sequence[int]], labels: Sequence[int], epochs: int = 5, rate: float = 0.3, l2: float = 1e-6, seed: int = 7) -> np.ndarray:
    """Logistic regression on hashed features by mini-batches with AdaGrad; float32 weights of fixed size."""
    weights = np.zeros(MASK + 1, np.float64)
    if not len(rows):
        return weights.astype(np.float32)
    grown = np.full(MASK + 1, 1e-3)
    sizes = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    flat = np.fromiter((x for r in rows for x in r), np.int64, int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    y = np.asarray(labels, np.float64)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            batch = order[at : at + 256]
            of = np.repeat(np.arange(len(batch)), sizes[batch])
            cols = np.concatenate([flat[starts[i] : starts[i + 1]] for i in batch])
            z = np.bincount(of, weights[cols], len(batch))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            used, where = np.unique(cols, return_inverse=True)
            grad = np.bincount(where, (p - y[batch])[of], len(used)) + l2 * weights[used]
            grown[used] += grad * grad
            weights[used] -= rate * grad / np.sqrt(grown[used])
    return weights.astype(np.float32)


def score(weights: np.ndarray, row: Sequence[int]) -> float:
    return float(sum(weights[i] for i in row))


def scores(weights: np.ndarray, rows: Sequence[Sequence[int]]) -> np.ndarray:
    """Linear scores of many rows at once."""
    sizes = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    if not sizes.sum():
        return np.zeros(len(rows))
    flat = np.fromiter((x for r in rows for x in r), np.int64, int(sizes.sum()))
    return np.bincount(np.repeat(np.arange(len(rows)), sizes), weights[flat], len(rows))
