"""Networks of convolution, pooling, activation, recurrent and dense layers.

Every layer but the last works on single features: each of its nodes is applied
to each incoming feature, so the number of features is multiplied by the number
of nodes (node-major order). The last layer is fully connected with a sigmoid.
Values travel as ``(rows, features, *shape)``. Parameters are stored layer by
layer and node by node, each node's weights followed by its bias.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import product
from math import prod

import numpy as np

from gradframe.functions.models import _Sums, sigmoid


@dataclass(frozen=True)
class Conv:
    """``nodes`` valid convolutions of stride 1 with a 1-, 2- or 3-D kernel."""

    nodes: int
    kernel: tuple[int, ...]

    def out(self, features, shape):
        return features * self.nodes, tuple(n - k + 1 for n, k in zip(shape, self.kernel))

    def size(self, features, shape):
        return self.nodes * (prod(self.kernel) + 1)

    def forward(self, x, w, state=None):
        block = w.reshape(self.nodes, -1)
        axes = tuple(range(2, x.ndim))
        windows = np.lib.stride_tricks.sliding_window_view(x, self.kernel, axis=axes)
        flat = windows.reshape(*windows.shape[: x.ndim], -1)
        y = np.tensordot(flat, block[:, :-1], axes=([-1], [1])) + block[:, -1]
        y = np.moveaxis(y, -1, 1)
        return y.reshape(len(x), -1, *y.shape[3:]), (x, flat)

    def backward(self, dy, kept, w, carry=None):
        x, flat = kept
        block = w.reshape(self.nodes, -1)
        dy = dy.reshape(len(x), self.nodes, x.shape[1], *dy.shape[2:])
        spread_dy = dy.reshape(len(x), self.nodes, -1)
        dw = np.einsum("mnp,mpk->mnk", spread_dy, flat.reshape(len(x), -1, flat.shape[-1]))
        dw = np.concatenate([dw, spread_dy.sum(axis=2)[:, :, None]], axis=2)
        dx = np.zeros_like(x)
        for i, offset in enumerate(product(*[range(k) for k in self.kernel])):
            here = (slice(None), slice(None)) + tuple(
                slice(o, o + n) for o, n in zip(offset, dy.shape[3:])
            )
            dx[here] += np.tensordot(dy, block[:, i], axes=([1], [0]))
        return dx, dw.reshape(len(x), -1), None


@dataclass(frozen=True)
class Pool:
    """Non-overlapping max or min over blocks; a ragged last block is kept."""

    kind: str
    block: tuple[int, ...]

    def out(self, features, shape):
        return features, tuple(-(-n // k) for n, k in zip(shape, self.block))

    def size(self, features, shape):
        return 0

    def forward(self, x, w, state=None):
        fill = -np.inf if self.kind == "max" else np.inf
        pad = [(0, 0), (0, 0)] + [(0, -n % k) for n, k in zip(x.shape[2:], self.block)]
        padded = np.pad(x, pad, constant_values=fill)
        shape = [padded.shape[0], padded.shape[1]]
        for n, k in zip(padded.shape[2:], self.block):
            shape += [n // k, k]
        cells = padded.reshape(shape)
        axes = tuple(range(3, len(shape), 2))
        y = cells.max(axis=axes) if self.kind == "max" else cells.min(axis=axes)
        return y, (x.shape, cells, axes, y)

    def backward(self, dy, kept, w, carry=None):
        shape, cells, axes, y = kept
        equal = cells == np.expand_dims(y, axes)  # every tied cell gets the gradient
        dx = equal * np.expand_dims(dy, axes)
        full = shape[:2] + tuple(n * k for n, k in zip(y.shape[2:], self.block))
        dx = dx.reshape(full)[tuple(slice(0, n) for n in shape)]
        return dx, np.zeros((shape[0], 0)), None


@dataclass(frozen=True)
class Act:
    """Element-wise ``relu``, ``sigmoid`` or ``tanh``."""

    kind: str

    def out(self, features, shape):
        return features, shape

    def size(self, features, shape):
        return 0

    def forward(self, x, w, state=None):
        if self.kind == "relu":
            return np.maximum(x, 0), (x >= 0).astype(float)
        y = sigmoid(x) if self.kind == "sigmoid" else np.tanh(x)
        return y, y * (1 - y) if self.kind == "sigmoid" else 1 - y * y

    def backward(self, dy, slope, w, carry=None):
        return dy * slope, np.zeros((len(dy), 0)), None


@dataclass(frozen=True)
class WeightedSum:
    """One dense map without activation, ``targets`` values from each feature."""

    targets: int

    def out(self, features, shape):
        return features, (self.targets,)

    def size(self, features, shape):
        return self.targets * (prod(shape) + 1)

    def forward(self, x, w, state=None):
        flat = x.reshape(*x.shape[:2], -1)
        block = w.reshape(self.targets, -1)
        return flat @ block[:, :-1].T + block[:, -1], (x.shape, flat)

    def backward(self, dy, kept, w, carry=None):
        shape, flat = kept
        block = w.reshape(self.targets, -1)
        dw = np.einsum("mft,mfn->mtn", dy, flat)
        dw = np.concatenate([dw, dy.sum(axis=1)[:, :, None]], axis=2)
        return (dy @ block[:, :-1]).reshape(shape), dw.reshape(len(dy), -1), None


@dataclass(frozen=True)
class Recurrent:
    """``nodes`` recurrent units of ``k`` cells: ``act(W x + U h + b)``.

    Each cell stores its input weights, its recurrent weights and its bias.
    The hidden state is carried from step to step of a sequence.
    """

    nodes: int
    kind: str
    k: int

    def out(self, features, shape):
        return features * self.nodes, (self.k,)

    def size(self, features, shape):
        return self.nodes * self.k * (prod(shape) + self.k + 1)

    def _parts(self, w, n):
        block = w.reshape(self.nodes, self.k, n + self.k + 1)
        return block[:, :, :n], block[:, :, n:-1], block[:, :, -1]

    def forward(self, x, w, state=None):
        flat = x.reshape(*x.shape[:2], -1)
        W, U, b = self._parts(w, flat.shape[2])
        h = np.zeros((len(x), self.nodes, x.shape[1], self.k)) if state is None else state
        z = np.einsum("mfn,qkn->mqfk", flat, W) + np.einsum("mqfj,qkj->mqfk", h, U)
        z += b[None, :, None, :]
        y = sigmoid(z) if self.kind == "sigmoid" else np.tanh(z)
        return y.reshape(len(x), -1, self.k), (x.shape, flat, h, y)

    def backward(self, dy, kept, w, carry=None):
        shape, flat, h, y = kept
        W, U, _ = self._parts(w, flat.shape[2])
        dy = dy.reshape(y.shape)
        if carry is not None:
            dy = dy + carry
        dz = dy * (y * (1 - y) if self.kind == "sigmoid" else 1 - y * y)
        dw = np.concatenate(
            [
                np.einsum("mqfk,mfn->mqkn", dz, flat),
                np.einsum("mqfk,mqfj->mqkj", dz, h),
                dz.sum(axis=2)[..., None],
            ],
            axis=3,
        )
        dx = np.einsum("mqfk,qkn->mfn", dz, W).reshape(shape)
        return dx, dw.reshape(len(dz), -1), np.einsum("mqfk,qkj->mqfj", dz, U)


@dataclass(frozen=True)
class Dense:
    """``nodes`` sigmoid outputs over all features; the last layer."""

    nodes: int

    def out(self, features, shape):
        return self.nodes, (1,)

    def size(self, features, shape):
        return self.nodes * (features * prod(shape) + 1)

    def forward(self, x, w, state=None):
        flat = x.reshape(len(x), -1)
        block = w.reshape(self.nodes, -1)
        y = sigmoid(flat @ block[:, :-1].T + block[:, -1])
        return y, (x.shape, flat, y)

    def backward(self, dy, kept, w, carry=None):
        shape, flat, y = kept
        block = w.reshape(self.nodes, -1)
        dz = dy * y * (1 - y)
        flat = np.hstack([flat, np.ones((len(flat), 1))])
        dw = np.einsum("mn,mp->mnp", dz, flat).reshape(len(dz), -1)
        return (dz @ block[:, :-1]).reshape(shape), dw, None


@dataclass(frozen=True)
class Net(_Sums):
    """A network over inputs of one fixed shape."""

    shape: tuple[int, ...]
    layers: tuple

    @cached_property
    def spans(self):
        """Slice of the parameter vector per layer."""
        at, features, shape, spans = 0, 1, self.shape, []
        for layer in self.layers:
            size = layer.size(features, shape)
            spans.append(slice(at, at + size))
            at += size
            features, shape = layer.out(features, shape)
        return spans

    @property
    def inputs(self) -> int:
        return prod(self.shape)

    @property
    def outputs(self) -> int:
        return self.layers[-1].nodes

    @property
    def width(self) -> int:
        return self.spans[-1].stop

    def step(self, x, w, states):
        x = x.reshape(len(x), 1, *self.shape)
        kept, after = [], []
        for layer, span, state in zip(self.layers, self.spans, states):
            x, keep = layer.forward(x, w[span], state)
            kept.append(keep)
            after.append(keep[3] if isinstance(layer, Recurrent) else None)
        return x, kept, after

    def back(self, dy, kept, w, carries, grad):
        before = []
        for layer, span, keep, carry in zip(
            self.layers[::-1], self.spans[::-1], kept[::-1], carries[::-1]
        ):
            dy, dw, out = layer.backward(dy, keep, w[span], carry)
            grad[:, span] += dw
            before.append(out)
        return before[::-1]

    def score(self, X, w):
        return self.step(X, w, [None] * len(self.layers))[0]

    def loss(self, P, Y):
        return ((P - Y) ** 2).sum(axis=1)

    def grad_rows(self, X, Y, w):
        none = [None] * len(self.layers)
        P, kept, _ = self.step(X, w, none)
        grad = np.zeros((len(X), self.width))
        self.back(P - Y, kept, w, none, grad)
        return grad, self.loss(P, Y)


@dataclass(frozen=True)
class SeqNet(Net):
    """A network run over the steps of a sequence; the last output counts.

    ``X`` is ``(rows, steps, inputs)`` with one number of steps per batch.
    """

    def score(self, X, w):
        states = [None] * len(self.layers)
        for t in range(X.shape[1]):
            P, _, states = self.step(X[:, t], w, states)
        return P

    def grad_rows(self, X, Y, w):
        states, trace = [None] * len(self.layers), []
        for t in range(X.shape[1]):
            P, kept, states = self.step(X[:, t], w, states)
            trace.append(kept)
        grad = np.zeros((len(X), self.width))
        carries = [None] * len(self.layers)
        for t, kept in reversed(list(enumerate(trace))):
            last = t == X.shape[1] - 1
            carries = self.back(P - Y if last else np.zeros_like(P), kept, w, carries, grad)
        return grad, self.loss(P, Y)
