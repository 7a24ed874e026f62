"""Linear-chain conditional random fields over categorical features, in numpy batches.

Tokens of all sequences lie in one flat array; ``feats[token, slot]`` names a row of the weight table,
so a token's label scores are a sum of rows. Sequences are taken longest first: step t of a pass then
works on the first n_t of them at once.
"""

from __future__ import annotations

import numpy as np


class Layout:
    """Where the tokens of each sequence lie, time by time."""

    def __init__(self, lengths: np.ndarray) -> None:
        lengths = np.asarray(lengths, np.int64)
        begins = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        self.n = int(lengths.sum())
        self.starts, sizes = begins[order], lengths[order]
        self.top = int(sizes[0]) if len(sizes) else 0
        self.active = np.searchsorted(-sizes, -np.arange(self.top), "left")
        self.last = self.starts + sizes - 1

    def at(self, t: int) -> np.ndarray:
        return self.starts[: self.active[t]] + t


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def forward_backward(scores: np.ndarray, trans: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of every token, summed expected transitions, and the sum of log partition functions."""
    labels = scores.shape[1]
    alpha, beta = np.array(scores), np.zeros_like(scores)
    for t in range(1, lay.top):
        now = lay.at(t)
        alpha[now] += _lse(alpha[now - 1][:, :, None] + trans, 1)
    for t in range(lay.top - 1, 0, -1):
        now = lay.at(t)
        beta[now - 1] = _lse(trans + (scores[now] + beta[now])[:, None, :], 2)
    z = np.zeros(lay.n)
    log_z = _lse(alpha[lay.last], 1) if lay.top else np.zeros(0)
    pairs = np.zeros((labels, labels))
    for t in range(lay.top):
        now = lay.at(t)
        z[now] = log_z[: len(now)]
        if t:
            x = alpha[now - 1][:, :, None] + trans + (scores[now] + beta[now])[:, None, :] - z[now][:, None, None]
            pairs += np.exp(x).sum(0)
    return np.exp(alpha + beta - z[:, None]), pairs, float(log_z.sum())


def viterbi(scores: np.ndarray, trans: np.ndarray, lay: Layout) -> np.ndarray:
    """The best label of every token; ties to the smaller label."""
    best, back = np.array(scores), np.zeros(scores.shape, np.int8)
    for t in range(1, lay.top):
        now = lay.at(t)
        x = best[now - 1][:, :, None] + trans
        back[now] = x.argmax(1)
        best[now] += x.max(1)
    out = np.zeros(lay.n, np.int8)
    out[lay.last] = best[lay.last].argmax(1)
    for t in range(lay.top - 1, 0, -1):
        now = lay.at(t)
        out[now - 1] = back[now, out[now]]
    return out


def fit(feats: np.ndarray, gold: np.ndarray, lengths: np.ndarray, rows: int, labels: int, rounds: int = 80, rate: float = 0.3, penalty: float = 1.0, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) of the penalised maximum likelihood, by Adagrad over the full data."""
    lay = Layout(lengths)
    w, trans = np.zeros((rows, labels)), np.zeros((labels, labels))
    if not lay.n:
        return w, trans
    order = [np.argsort(feats[:, f], kind="stable") for f in range(feats.shape[1])]
    turns = [np.flatnonzero(np.concatenate([[True], np.diff(feats[o, f]) > 0])) for f, o in enumerate(order)]
    names = [feats[o[s], f] for f, (o, s) in enumerate(zip(order, turns))]
    first = np.zeros(lay.n, bool)
    begins = np.cumsum(lengths) - lengths
    first[begins[np.asarray(lengths) > 0]] = True
    inner = np.flatnonzero(~first)
    seen = np.zeros((labels, labels))
    np.add.at(seen, (gold[inner - 1], gold[inner]), 1.0)
    sum_w, sum_t = np.full_like(w, 1e-8), np.full_like(trans, 1e-8)
    for _ in range(rounds):
        marginal, pairs, _ = forward_backward(score(feats, w), trans, lay)
        delta = -marginal
        delta[np.arange(lay.n), gold] += 1.0
        grad = -penalty * w
        for o, s, k in zip(order, turns, names):
            grad[k] += np.add.reduceat(delta[o], s, axis=0)
        grad_t = seen - pairs - penalty * trans
        sum_w += grad**2
        sum_t += grad_t**2
        w += rate * grad / np.sqrt(sum_w)
        trans += rate * grad_t / np.sqrt(sum_t)
    return w, trans


def score(feats: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros((len(feats), w.shape[1]))
    for f in range(feats.shape[1]):
        out += w[feats[:, f]]
    return out
