"""Linear-chain conditional random fields over many documents at once: numpy, in lockstep over positions.

All words of a block lie in one emission array; documents (or segments of them) are ordered by length and step t works
on all those longer than t. Forward-backward cuts documents into segments whose transfer matrices are multiplied first,
so a very long document takes few steps; the result is the same as in one piece.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 128


def _lockstep(starts: np.ndarray, lengths: np.ndarray):
    """Yields (t, n): the first n chains, longest first, still have a word t. Chains must be ordered by length."""
    alive = np.searchsorted(-lengths, -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")
    for t, n in enumerate(alive.tolist()):
        yield t, n


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.max(axis=-1, keepdims=True)


def forward_backward(emissions: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward values of every word, up to a factor per word, and exp(emissions) likewise scaled.

    The marginals of word i are ``forward[i] * backward[i]``, normalised.
    """
    labels = len(start)
    psi = np.exp(emissions - emissions.max(axis=1, keepdims=True)) if len(emissions) else emissions
    step, u0 = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    forward, backward = np.ones_like(psi), np.ones_like(psi)
    n_words = np.diff(first)
    pieces = -(-n_words // segment)
    doc = np.repeat(np.arange(len(n_words)), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[doc] + number * segment
    size = np.minimum(segment, first[doc + 1] - begin) if len(doc) else begin
    order = np.argsort(-size, kind="stable")
    begin, size, doc, number = begin[order], size[order], doc[order], number[order]
    if not len(begin):
        return forward, backward, psi
    many = int(number.max()) > 0
    prior = np.tile(u0, (len(begin), 1))
    after = np.ones((len(begin), labels))
    if many:
        matrix = np.zeros((len(begin), labels, labels))
        for t, n in _lockstep(begin, size):
            now = psi[begin[:n] + t]
            if t == 0:
                matrix[:n][:, np.arange(labels), np.arange(labels)] = now
            else:
                m = (matrix[:n].reshape(-1, labels) @ step).reshape(n, labels, labels) * now[:, None, :]
                matrix[:n] = m / m.max(axis=(1, 2), keepdims=True)
        at = np.full((len(n_words), int(number.max()) + 1), -1)
        at[doc, number] = np.arange(len(doc))
        for k in range(1, at.shape[1]):
            here = at[:, k][at[:, k] >= 0]
            before = at[doc[here], k - 1]
            prior[here] = _unit(np.einsum("ni,nij->nj", prior[before], matrix[before]) @ step)
        for k in range(at.shape[1] - 1, 0, -1):
            here = at[:, k][at[:, k] >= 0]
            before = at[doc[here], k - 1]
            after[before] = _unit(np.einsum("nij,nj->ni", matrix[here], after[here]) @ step.T)
    value = prior
    for t, n in _lockstep(begin, size):
        i = begin[:n] + t
        value = prior * psi[i] if t == 0 else (value[:n] @ step) * psi[i]
        value = _unit(value)
        forward[i] = value
    value = after.copy()
    last = begin + size - 1
    backward[last] = value
    for t in range(int(size.max()) - 1, 0, -1):
        n = int(np.searchsorted(-size, -t, side="left"))  # chains with a word t
        i = begin[:n] + t
        backward[i - 1] = _unit((psi[i] * backward[i]) @ step.T)
    return forward, backward, psi


def marginals(emissions: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    f, b, _ = forward_backward(emissions, first, transitions, start)
    p = f * b
    return p / p.sum(axis=1, keepdims=True) if len(p) else p


def gradient(emissions: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected minus observed counts: per word and label, per label pair, per first label."""
    f, b, psi = forward_backward(emissions, first, transitions, start)
    p = f * b
    p /= p.sum(axis=1, keepdims=True)
    inner = np.ones(len(p), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    i = np.flatnonzero(inner)
    pair = f[i - 1][:, :, None] * np.exp(transitions - transitions.max()) * (psi[i] * b[i])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    pairs = pair.sum(axis=0)
    np.subtract.at(pairs, (labels[i - 1], labels[i]), 1)
    p[np.arange(len(p)), labels] -= 1
    return p, pairs, p[~inner].sum(axis=0)


def viterbi(emissions: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best label of every word."""
    out = np.zeros(len(emissions), np.int64)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    back = np.zeros((len(emissions), len(start)), np.int8)
    value = np.zeros((len(begin), len(start)), emissions.dtype)
    for t, n in _lockstep(begin, size):
        i = begin[:n] + t
        if t == 0:
            value[:n] = start + emissions[i]
            continue
        through = value[:n, :, None] + transitions
        back[i] = through.argmax(axis=1)
        value[:n] = through.max(axis=1) + emissions[i]
    best = value.argmax(axis=1)
    some = size > 0
    out[(begin + size - 1)[some]] = best[some]
    for t in range(int(size.max(initial=0)) - 1, 0, -1):
        n = int(np.searchsorted(-size, -t, side="left"))
        i = begin[:n] + t
        best[:n] = np.where(size[:n] - 1 >= t, back[i, best[:n]], best[:n])
        out[i - 1] = best[:n]
    return out


class Adagrad:
    """Gradient steps with a rate per weight."""

    def __init__(self, rate: float) -> None:
        self.rate, self.seen = rate, {}

    def step(self, name: str, weights: np.ndarray, g: np.ndarray) -> None:
        seen = self.seen.setdefault(name, np.full(weights.shape, 1e-6))
        seen += g * g
        weights -= self.rate * g / np.sqrt(seen)
