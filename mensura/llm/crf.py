"""A linear-chain conditional random field over numpy arrays, shared by the line and the DOM-block labellers.

Sequences are stored end to end.  Forward-backward, gradients and Viterbi run over all sequences of a batch at
once, position by position, longest sequences first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    """weights (features x labels), transitions (labels x labels), start (labels), and the features' scaling."""

    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


class _Layout:
    """Row numbers of each position of the sequences, longest first, so that those still running are a prefix."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)
        order = np.argsort(-lengths, kind="stable")
        self.starts, self.lengths = starts[order], lengths[order]
        self.running = np.searchsorted(-self.lengths, -np.arange(1, (self.lengths[0] if len(lengths) else 0) + 1), side="right")

    def rows(self, t: int) -> np.ndarray:
        return self.starts[: self.running[t]] + t

    def __len__(self) -> int:
        return len(self.running)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(model: Model, emissions: np.ndarray, lengths: np.ndarray, pairs: bool = False):
    """Label probabilities of every row; with pairs also the expected transition and start counts and the log
    likelihood's normalisers."""
    at = _Layout(lengths)
    labels = emissions.shape[1]
    ahead, back = np.zeros_like(emissions), np.zeros_like(emissions)
    for t in range(len(at)):
        r = at.rows(t)
        ahead[r] = emissions[r] + (model.start if t == 0 else _log_sum(ahead[r - 1][:, :, None] + model.transitions, 1))
    for t in range(len(at) - 2, -1, -1):
        r = at.rows(t + 1)
        back[r - 1] = _log_sum(model.transitions[None] + (emissions[r] + back[r])[:, None, :], 2)
    last = at.starts + at.lengths - 1
    last, first = last[at.lengths > 0], at.starts[at.lengths > 0]
    norm_of = np.zeros(len(emissions))
    norms = _log_sum(ahead[last], 1)
    for a, b, z in zip(first, last, norms):
        norm_of[a : b + 1] = z
    p = np.exp(ahead + back - norm_of[:, None])
    if not pairs:
        return p
    expected = np.zeros((labels, labels))
    for t in range(1, len(at)):
        r = at.rows(t)
        joint = ahead[r - 1][:, :, None] + model.transitions + (emissions[r] + back[r])[:, None, :] - norm_of[r][:, None, None]
        expected += np.exp(joint).sum(0)
    return p, expected, p[first].sum(0), norms.sum()


def viterbi(model: Model, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The most probable label of every row."""
    at = _Layout(lengths)
    best, came = np.zeros_like(emissions), np.zeros(emissions.shape, int)
    for t in range(len(at)):
        r = at.rows(t)
        if t == 0:
            best[r] = emissions[r] + model.start
        else:
            paths = best[r - 1][:, :, None] + model.transitions
            came[r] = paths.argmax(1)
            best[r] = emissions[r] + paths.max(1)
    out = np.zeros(len(emissions), int)
    for t in range(len(at) - 1, -1, -1):
        r = at.rows(t)
        ends = at.lengths[: len(r)] == t + 1
        out[r[ends]] = best[r[ends]].argmax(1)
        go = r[~ends]
        out[go] = came[go + 1, out[go + 1]]
    return out


def train(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, labels: int = 2, steps: int = 120, l2: float = 1e-3, rate: float = 0.1) -> Model:
    """Maximum likelihood with an L2 penalty by Adam over the whole (bounded) sample.  Without rows: a model that
    prefers no label."""
    d = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(d)
    scale = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(d)
    model = Model(np.zeros((d + 1, labels)), np.zeros((labels, labels)), np.zeros(labels), mean, scale)
    if not len(x):
        return model
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    truth = np.eye(labels)[y]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[np.asarray(lengths) > 0].astype(int)
    inner = np.ones(len(x), bool)
    inner[starts] = False
    to = np.flatnonzero(inner)
    seen = np.zeros((labels, labels))
    np.add.at(seen, (y[to - 1], y[to]), 1)
    seen_start = truth[starts].sum(0)
    parts = [model.weights, model.transitions, model.start]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for k in range(1, steps + 1):
        p, pair, begun, _ = marginals(model, z @ model.weights, lengths, pairs=True)
        slopes = [z.T @ (truth - p), seen - pair, seen_start - begun]
        for i, (part, slope) in enumerate(zip(parts, slopes)):
            slope = slope / len(x) - l2 * part
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.99 * second[i] + 0.01 * slope**2
            part += rate * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.99**k)) + 1e-8)
    return model


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights (last: intercept) of a logistic regression by Newton's method, with an L2 penalty but for the
    intercept.  Labels of one kind only are met by counting one row of each kind more."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-6
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty * len(y) / 100 + 1e-9), z.T @ (y - p) - penalty * len(y) / 100 * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
