"""Models over whole batches.

A model turns a batch ``X`` (rows x inputs) and one flat parameter vector into
outputs, losses and gradients with array operations. Spark splits the rows and
adds up the results; a model only ever sees one Arrow batch.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np

from gradframe.functions.vec import MAX_LOG_LOSS

HELD_VALUES = 1 << 22  # numbers of row gradients held at a time


class Model(Protocol):
    """What scoring, training and priorities need from a model."""

    inputs: int
    outputs: int
    width: int  # length of the parameter vector

    def score(self, X: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Outputs, one row per input row."""

    def loss(self, P: np.ndarray, Y: np.ndarray) -> np.ndarray:
        """Loss per row."""

    def grad_rows(self, X, Y, w) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and loss per row."""

    def grad_sum(self, X, Y, w) -> tuple[np.ndarray, float]:
        """Sum of gradients and of losses over the batch."""

    def measures(self, X, Y, w, direction=None) -> tuple[np.ndarray, np.ndarray, float]:
        """Squared gradient length per row, or projection on ``direction``; and what ``grad_sum`` gives."""


def sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-z))


class _Sums:
    """Sums over gradients of single rows, of which few are held at a time."""

    def grad_sum(self, X, Y, w):
        return self.measures(X, Y, w)[1:]

    def measures(self, X, Y, w, direction=None):
        at_once = max(1, HELD_VALUES // self.width)
        p, total, lost = np.empty(len(X)), np.zeros(self.width), 0.0
        for low in range(0, len(X), at_once):
            part = slice(low, low + at_once)
            g, loss = self.grad_rows(X[part], Y[part], w)
            p[part] = np.einsum("mj,mj->m", g, g) if direction is None else g @ direction
            total += g.sum(axis=0)
            lost += float(loss.sum())
        return p, total, lost


def _layer_measure(source: np.ndarray, delta: np.ndarray, direction: np.ndarray | None) -> np.ndarray:
    """Share of one layer in the squared length or projection of each row's gradient.

    The gradient is the outer product of ``(source, 1)`` and ``delta``, which is not formed.
    """
    if direction is None:
        return (np.einsum("ma,ma->m", source, source) + 1) * np.einsum("mb,mb->m", delta, delta)
    return np.einsum("mb,mb->m", source @ direction[:-1] + direction[-1], delta)


@dataclass(frozen=True)
class LR(_Sums):
    """Logistic regression; parameters are the weights, then the bias."""

    inputs: int
    outputs = 1

    @property
    def width(self) -> int:
        return self.inputs + 1

    def score(self, X, w):
        return sigmoid(X @ w[:-1] + w[-1])[:, None]

    def loss(self, P, Y):
        p, y = P[:, 0], Y[:, 0]
        hit = np.where(y == 0, 1 - p, p)
        with np.errstate(divide="ignore"):
            return np.where(hit <= 0, MAX_LOG_LOSS, -np.log(np.maximum(hit, 0)))

    def grad_rows(self, X, Y, w):
        P = self.score(X, w)
        err = P - Y
        return np.hstack([X * err, err]), self.loss(P, Y)

    def measures(self, X, Y, w, direction=None):
        P = self.score(X, w)
        err = P - Y
        part = None if direction is None else np.asarray(direction, float)[:, None]
        g = np.append(err[:, 0] @ X, err.sum())
        return _layer_measure(X, err, part), g, float(self.loss(P, Y).sum())


@dataclass(frozen=True)
class MLP(_Sums):
    """Sigmoid layers; per layer a (sources + bias) x targets block by rows.

    ``compat`` applies the sigmoid once more inside the output derivative,
    for users who must repeat runs trained that way.
    """

    sizes: tuple[int, ...]
    compat: bool = False

    @property
    def inputs(self) -> int:
        return self.sizes[0]

    @property
    def outputs(self) -> int:
        return self.sizes[-1]

    @property
    def width(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.sizes, self.sizes[1:]))

    def blocks(self, w):
        at = 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            yield w[at : at + (a + 1) * b].reshape(a + 1, b)
            at += (a + 1) * b

    def layers(self, X, w):
        out = [X]
        for block in self.blocks(w):
            out.append(sigmoid(out[-1] @ block[:-1] + block[-1]))
        return out

    def score(self, X, w):
        return self.layers(X, w)[-1]

    def loss(self, P, Y):
        return ((P - Y) ** 2).sum(axis=1)

    def _deltas(self, X, Y, w):
        out = self.layers(X, w)
        slope = sigmoid(out[-1]) if self.compat else out[-1]
        delta = (out[-1] - Y) * slope * (1 - slope)
        blocks = list(self.blocks(w))
        found = []
        for layer in range(len(blocks) - 1, -1, -1):
            found.append((out[layer], delta))
            if layer:
                delta = (delta @ blocks[layer][:-1].T) * out[layer] * (1 - out[layer])
        return found[::-1], self.loss(out[-1], Y)

    def grad_rows(self, X, Y, w):
        found, loss = self._deltas(X, Y, w)
        parts = []
        for source, delta in found:
            source = np.hstack([source, np.ones((len(X), 1))])
            parts.append(np.einsum("ma,mb->mab", source, delta).reshape(len(X), -1))
        return np.hstack(parts), loss

    def measures(self, X, Y, w, direction=None):
        found, loss = self._deltas(X, Y, w)
        parts = [np.vstack([s.T @ d, d.sum(axis=0)]).ravel() for s, d in found]
        along = [None] * len(found) if direction is None else self.blocks(np.asarray(direction, float))
        p = sum(_layer_measure(s, d, block) for (s, d), block in zip(found, along))
        return p, np.concatenate(parts), float(loss.sum())


@dataclass(frozen=True)
class KMeans:
    """Parameters per centre: coordinate sums, then a count."""

    k: int
    dim: int
    outputs = 1

    @property
    def inputs(self) -> int:
        return self.dim

    @property
    def width(self) -> int:
        return self.k * (self.dim + 1)

    def centres(self, w):
        block = np.asarray(w, float).reshape(self.k, self.dim + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(block[:, -1:] > 0, block[:, :-1] / block[:, -1:], np.nan)

    def nearest(self, X, w):
        """Index of and distance to the nearest non-empty centre."""
        far = np.empty((len(X), self.k))
        for c, centre in enumerate(self.centres(w)):
            gap = X - centre
            far[:, c] = np.sqrt(np.einsum("md,md->m", gap, gap))
        far = np.where(np.isnan(far), np.inf, far)
        z = far.argmin(axis=1)
        return z, far[np.arange(len(X)), z]

    def score(self, X, w):
        return self.nearest(X, w)[0].astype(float)[:, None]
