"""Linear-chain conditional random field over hashed features, trained on the driver from a bounded sample."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BITS = 16
MASK = (1 << BITS) - 1


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class ChainCRF:
    """emit: features by labels; step: label to label; begin: first label."""

    def __init__(self, labels: Sequence[str]) -> None:
        self.labels = list(labels)
        n = len(self.labels)
        self.emit = np.zeros((MASK + 1, n), np.float32)
        self.step = np.zeros((n, n), np.float32)
        self.begin = np.zeros(n, np.float32)

    def emissions(self, rows: Sequence[Sequence[int]]) -> np.ndarray:
        return np.array([self.emit[r].sum(axis=0) for r in rows], np.float64).reshape(len(rows), len(self.labels))

    def marginals(self, unary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label and pair marginals of one sequence by forward and backward sums."""
        single, pair = self._expected(np.asarray(unary, np.float64)[None])
        return single[0], pair

    def fit(self, sequences: Sequence[tuple[Sequence[Sequence[int]], Sequence[int]]], epochs: int = 3, rate: float = 0.2, batch: int = 64, seed: int = 5) -> ChainCRF:
        """Gradient of the conditional log-likelihood with AdaGrad, on batches of sequences of one length."""
        n = len(self.labels)
        grown = np.full(self.emit.shape, 0.05)
        grown_step, grown_begin = np.full(self.step.shape, 0.05), np.full(self.begin.shape, 0.05)
        rng = np.random.default_rng(seed)
        by: dict[int, list[int]] = {}
        for i, (rows, _) in enumerate(sequences):
            by.setdefault(len(rows), []).append(i)
        for _ in range(epochs):
            batches = [part for group in by.values() for part in np.array_split(rng.permutation(group), -(-len(group) // batch))]
            for at in rng.permutation(len(batches)):
                chosen = [sequences[i] for i in batches[at]]
                length, many = len(chosen[0][0]), len(chosen)
                flat = np.concatenate([np.asarray(row, np.int64) for rows, _ in chosen for row in rows])
                of = np.repeat(np.arange(many * length), [len(row) for rows, _ in chosen for row in rows])
                tags = np.array([t for _, t in chosen])
                unary = np.stack([np.bincount(of, self.emit[flat, k], many * length) for k in range(n)], -1).reshape(many, length, n)
                single, pair = self._expected(unary)
                gap = np.eye(n)[tags] - single
                used, where = np.unique(flat, return_inverse=True)
                pull = gap.reshape(-1, n)[of]
                g = np.stack([np.bincount(where, pull[:, k], len(used)) for k in range(n)], -1)
                grown[used] += g * g
                self.emit[used] += rate * g / np.sqrt(grown[used])
                g = -pair
                np.add.at(g, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
                grown_step += g * g
                self.step += (rate * g / np.sqrt(grown_step)).astype(np.float32)
                g = gap[:, 0].sum(axis=0)
                grown_begin += g * g
                self.begin += (rate * g / np.sqrt(grown_begin)).astype(np.float32)
        return self

    def _expected(self, unary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label marginals of every sequence of a batch, and the sum of their pair marginals."""
        length = unary.shape[1]
        ahead, back = np.zeros_like(unary), np.zeros_like(unary)
        ahead[:, 0] = self.begin + unary[:, 0]
        for t in range(1, length):
            ahead[:, t] = unary[:, t] + _logsum(ahead[:, t - 1][:, :, None] + self.step, 1)
        for t in range(length - 2, -1, -1):
            back[:, t] = _logsum(self.step + (unary[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        total = _logsum(ahead[:, -1], 1)
        single = np.exp(ahead + back - total[:, None, None])
        pair = np.zeros(self.step.shape)
        for t in range(1, length):
            pair += np.exp(ahead[:, t - 1][:, :, None] + self.step + (unary[:, t] + back[:, t])[:, None, :] - total[:, None, None]).sum(axis=0)
        return single, pair

    def best(self, unary: np.ndarray) -> list[int]:
        """The most likely labels (Viterbi)."""
        if len(unary) == 1:
            return [int((self.begin + unary[0]).argmax())]
        state = self.begin + unary[0]
        trail = []
        for t in range(1, len(unary)):
            moves = state[:, None] + self.step
            trail.append(moves.argmax(axis=0))
            state = moves.max(axis=0) + unary[t]
        at = int(state.argmax())
        path = [at]
        for arrows in reversed(trail):
            at = int(arrows[at])
            path.append(at)
        return path[::-1]
