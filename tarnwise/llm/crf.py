"""A small linear-chain conditional random field over dense features."""

from __future__ import annotations

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Crf:
    """Tags sequences of feature vectors; weights are (features x tags), moves (tags x tags), first (tags)."""

    def __init__(self, n_features: int, n_tags: int):
        self.w = np.zeros((n_features, n_tags))
        self.move = np.zeros((n_tags, n_tags))
        self.first = np.zeros(n_tags)

    def _scores(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Emissions, forward and backward log sums (n, t, k), and log partition (n)."""
        n, t, _ = x.shape
        emit = x @ self.w
        fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
        fwd[:, 0] = emit[:, 0] + self.first
        for i in range(1, t):
            nxt = _lse(fwd[:, i - 1][:, :, None] + self.move[None], 1) + emit[:, i]
            fwd[:, i] = np.where(mask[:, i, None], nxt, fwd[:, i - 1])
        for i in range(t - 2, -1, -1):
            prev = _lse(self.move[None] + (emit[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
            bwd[:, i] = np.where(mask[:, i + 1, None], prev, 0.0)
        return emit, fwd, bwd, _lse(fwd[:, -1], 1)

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, rounds: int = 200, l2: float = 1e-3, rate: float = 0.1) -> Crf:
        """Maximise the regularised likelihood by Adam on the whole sample. x (n, t, f), y (n, t), mask (n, t)."""
        n, t, _ = x.shape
        k = len(self.first)
        hot = np.eye(k)[y] * mask[:, :, None]
        params = [self.w, self.move, self.first]
        seen_w = np.einsum("ntf,ntk->fk", x, hot)
        pairs = mask[:, 1:] & mask[:, :-1]
        seen_move = np.einsum("ntj,ntk->jk", hot[:, :-1] * pairs[:, :, None], hot[:, 1:])
        seen_first = hot[:, 0].sum(0)
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, rounds + 1):
            emit, fwd, bwd, z = self._scores(x, mask)
            post = np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
            edge = fwd[:, :-1, :, None] + self.move[None, None] + (emit + bwd)[:, 1:, None, :] - z[:, None, None, None]
            expected_move = (np.exp(edge) * pairs[:, :, None, None]).sum((0, 1))
            grads = [
                (seen_w - np.einsum("ntf,ntk->fk", x, post)) / n - l2 * self.w,
                (seen_move - expected_move) / n - l2 * self.move,
                (seen_first - post[:, 0].sum(0)) / n - l2 * self.first,
            ]
            for p, g, a, b in zip(params, grads, m1, m2):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self

    def posteriors(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probability of each tag at each place (n, t, k)."""
        _, fwd, bwd, z = self._scores(x, mask)
        return np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
