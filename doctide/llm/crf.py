"""A two-label linear-chain conditional random field in numpy, over many sequences at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    """Scores of label k: ``x @ weights[:, k]``; moves between labels: ``moves[i, j]``."""

    weights: np.ndarray
    moves: np.ndarray


def _grid(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences by falling length, and where each starts in the flat rows."""
    order = np.argsort(-lengths, kind="stable")
    return order, (np.cumsum(lengths) - lengths)[order]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis)
    return top + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis))


def viterbi(model: Crf, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of all sequences' rows; step t handles every sequence longer than t. Ties go to label 0."""
    scores = x @ model.weights
    labels = np.zeros(len(x), np.int8)
    keep = lengths > 0
    order, starts = _grid(lengths[keep])
    ordered = lengths[keep][order]
    if not len(ordered):
        return labels
    back = np.zeros((len(x), 2), np.int8)
    best = scores[starts].copy()
    final = best.copy()
    for t in range(1, int(ordered[0])):
        n = int(np.searchsorted(-ordered, -t, "left"))
        paths = best[:n, :, None] + model.moves
        rows = starts[:n] + t
        back[rows] = paths.argmax(1)
        best = paths.max(1) + scores[rows]
        final[:n] = best
    label = final.argmax(1).astype(np.int8)
    labels[starts + ordered - 1] = label
    for t in range(int(ordered[0]) - 2, -1, -1):
        n = int(np.searchsorted(-ordered, -(t + 1), "left"))
        rows = starts[:n] + t
        labels[rows] = back[rows + 1, labels[rows + 1]]
    return labels


def fit(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, steps: int = 300, rate: float = 0.1, penalty: float = 1e-3) -> Crf:
    """Conditional maximum likelihood by Adam with an L2 penalty; the same rows give the same model."""
    lengths = lengths[lengths > 0]
    d, rows = x.shape[1], max(len(x), 1)
    theta = np.zeros(2 * d + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    order, starts = _grid(lengths)
    ordered = lengths[order]
    gold = np.eye(2)[y]
    inner = np.ones(len(x), bool)
    inner[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    for step in range(1, steps + 1):
        w, moves = theta[: 2 * d].reshape(d, 2), theta[2 * d :].reshape(2, 2)
        scores = x @ w
        forward, backward = scores.copy(), np.zeros_like(scores)
        longest = int(ordered[0]) if len(ordered) else 0
        for t in range(1, longest):
            n = int(np.searchsorted(-ordered, -t, "left"))
            r = starts[:n] + t
            forward[r] = scores[r] + _log_sum(forward[r - 1][:, :, None] + moves, 1)
        for t in range(longest - 2, -1, -1):
            n = int(np.searchsorted(-ordered, -(t + 1), "left"))
            r = starts[:n] + t
            backward[r] = _log_sum(moves + (scores[r + 1] + backward[r + 1])[:, None, :], 2)
        total = np.empty(len(x))
        total[:] = np.repeat(_log_sum(forward[np.cumsum(lengths) - 1], 1), lengths) if len(lengths) else 0
        share = np.exp(forward + backward - total[:, None])
        pair = np.exp(forward[at - 1][:, :, None] + moves + (scores[at] + backward[at])[:, None, :] - total[at][:, None, None])
        slope = np.concatenate([(x.T @ (gold - share)).ravel(), (seen - pair.sum(0)).ravel()]) / rows - penalty * theta
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Crf(theta[: 2 * d].reshape(d, 2).copy(), theta[2 * d :].reshape(2, 2).copy())
