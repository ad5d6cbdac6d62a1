"""Feed-forward networks: numpy layers, optimisers, a trainer over Spark, the
estimator and the autoencoder.

Layers work on batches (rows first). Training runs by epochs. With
``parallel=1`` batches follow each other in one task, as published results do: its
rows lie in a file, so its memory does not grow with them but for their order; with more parts each part trains an epoch from the same
weights and the weights are averaged by rows: one job an epoch, and only weights
come to the driver. Scoring is ``mapInArrow``-batched matrix products.
"""

from __future__ import annotations

import copy
import math
import os
import pickle
import tempfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.activations import jacobian
from brindle.functions.arrays import vector
from brindle.operators.base import Model, Options, log

# ---------------------------------------------------------------- activations (numpy)


def identity(z):
    return z


def relu(z):
    return np.maximum(z, 0.0)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def softplus(z):
    return np.logaddexp(0.0, z)


def mish(z):
    return z * np.tanh(softplus(z))


def elu(z):
    return np.where(z > 0, z, np.expm1(np.minimum(z, 0)))


def plu(z, alpha=0.1, c=1.0):
    return np.maximum(alpha * (z + c) - c, np.minimum(alpha * (z - c) + c, z))


def softmax(z):
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


DERIVATIVES: dict[Callable, Callable] = {
    identity: np.ones_like, relu: lambda z: (z > 0).astype(float), np.tanh: lambda z: 1 - np.tanh(z) ** 2, sigmoid: lambda z: sigmoid(z) * (1 - sigmoid(z)), softplus: sigmoid,
    mish: lambda z: np.tanh(softplus(z)) + z * (1 - np.tanh(softplus(z)) ** 2) * sigmoid(z), elu: lambda z: np.where(z > 0, 1.0, np.exp(np.minimum(z, 0))), plu: lambda z: np.where((z >= 0.1 * (z + 1) - 1) & (z <= 0.1 * (z + 1) + 1), 1.0, 0.1),
}


def derivative_of(f: Callable) -> Callable:
    """The known derivative, else central differences."""
    return DERIVATIVES.get(f) or (lambda z, h=1e-6: (f(z + h) - f(z - h)) / (2 * h))


def squared_cost(y, p):
    return 0.5 * ((y - p) ** 2).reshape(len(y), -1).sum(1)


def dsquared_cost(y, p):
    return p - y


def crossentropy(y, p):
    return -(y * np.log(p + 1e-15)).reshape(len(y), -1).sum(1)


def dcrossentropy(y, p):
    return -y / (p + 1e-15)


COST_DERIVATIVES: dict[Callable, Callable] = {squared_cost: dsquared_cost, crossentropy: dcrossentropy}

# ---------------------------------------------------------------- gradients


class Learnable:
    """The arrays of one layer's parameters or gradients, with arithmetic array by array.

    The other side is a Learnable of as many arrays, or a number for each of them."""

    def __init__(self, *data: np.ndarray):
        self.data = tuple(np.asarray(d, float) for d in data)

    def _with(self, other: Any, f: Callable) -> Learnable:
        others = other.data if isinstance(other, Learnable) else (other,) * len(self.data)
        return Learnable(*[f(a, b) for a, b in zip(self.data, others, strict=True)])

    def __add__(self, other):
        return self._with(other, np.add)

    def __sub__(self, other):
        return self._with(other, np.subtract)

    def __mul__(self, other):
        return self._with(other, np.multiply)

    def __truediv__(self, other):
        return self._with(other, np.divide)

    def __rsub__(self, other):
        return -self + other

    def __rtruediv__(self, other):
        return self._with(other, lambda a, b: b / a)

    __radd__, __rmul__ = __add__, __mul__  # sum() begins with 0

    def __neg__(self):
        return self * -1.0

    def sqrt(self) -> Learnable:
        return Learnable(*map(np.sqrt, self.data))

    def __eq__(self, other):
        return isinstance(other, Learnable) and len(self.data) == len(other.data) and all(map(np.array_equal, self.data, other.data))

    __hash__ = None

    def __repr__(self):
        return f"Learnable of shapes {', '.join(str(d.shape) for d in self.data)}"


# ---------------------------------------------------------------- layers


class Layer:
    """Base of layers. ``forward`` gives the output, ``backward`` the gradients of the
    input and of each parameter (summed over the batch) from that of the output."""

    params: list[np.ndarray] = []

    def forward(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def backward(self, x: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        raise NotImplementedError

    def size(self) -> tuple[tuple[int, ...], tuple[int, ...]]:
        raise NotImplementedError

    def get_params(self) -> list[np.ndarray]:
        return self.params

    def set_params(self, params: list[np.ndarray]) -> None:
        self.params = [np.asarray(p, float) for p in params]

    def get_learnable(self) -> Learnable:
        return Learnable(*self.get_params())

    def n_params(self) -> int:
        return sum(p.size for p in self.params)

    def random_init(self, rng: np.random.Generator) -> None:
        for p in self.params:
            bound = math.sqrt(6) / math.sqrt(sum(p.shape) if p.ndim > 1 else p.size + 1)
            p[...] = rng.uniform(-bound, bound, p.shape)

    def preprocess(self) -> None:
        """Hook before training."""


class DenseLayer(Layer):
    bias = True

    def __init__(self, n_in: int, n_out: int, f: Callable = identity, df: Callable | None = None, w=None, wb=None, seed: int = 123):
        rng = np.random.default_rng(seed)
        bound = math.sqrt(6) / math.sqrt(n_in + n_out)
        w = rng.uniform(-bound, bound, (n_out, n_in)) if w is None else np.asarray(w, float)
        wb = (rng.uniform(-bound, bound, n_out) if wb is None else np.asarray(wb, float)) if self.bias else None
        self.params = [w, wb] if self.bias else [w]
        self.f, self.df = f, df or derivative_of(f)

    def pre(self, x):
        z = x @ self.params[0].T
        return z + self.params[1] if self.bias else z

    def forward(self, x):
        return self.f(self.pre(x))

    def backward(self, x, grad):
        dz = grad * self.df(self.pre(x))
        return dz @ self.params[0], [dz.T @ x, dz.sum(0)] if self.bias else [dz.T @ x]

    def size(self):
        return (self.params[0].shape[1],), (self.params[0].shape[0],)


class DenseNoBiasLayer(DenseLayer):
    bias = False

    def __init__(self, n_in, n_out, f=identity, df=None, w=None, seed=123):
        super().__init__(n_in, n_out, f, df, w, None, seed)


class VectorFunctionLayer(Layer):
    """A function of the whole row, such as softmax, with an optional learnable parameter."""

    def __init__(self, n: int, f: Callable = softmax, n_out: int | None = None, w=None):
        self.n, self.n_out, self.f = n, n_out or n, f
        self.params = [] if w is None else [np.asarray(w, float)]

    def forward(self, x):
        return self.f(x, *self.params) if self.params or self.f is not softmax else softmax(x)

    def backward(self, x, grad):
        if self.f is softmax and not self.params:
            p = softmax(x)
            return p * (grad - (grad * p).sum(1, keepdims=True)), []
        one = lambda v, *w: np.asarray(self.f(v[None], *w)).reshape(-1)
        dx = np.stack([g @ jacobian(lambda v: one(v, *self.params), r) for r, g in zip(x, grad, strict=True)])
        dw = [sum((g @ jacobian(lambda w, r=r: one(r, w.reshape(p.shape)), p.ravel())).reshape(p.shape) for r, g in zip(x, grad, strict=True)) for p in self.params]
        return dx, dw

    def size(self):
        return (self.n,), (self.n_out,)


class ScalarFunctionLayer(Layer):
    """The same function at each node, with an optional learnable parameter."""

    def __init__(self, n: int, f: Callable = np.tanh, df: Callable | None = None, w=None):
        self.n, self.f, self.df = n, f, df or derivative_of(f)
        self.params = [] if w is None else [np.asarray(w, float)]

    def forward(self, x):
        return self.f(x, *self.params)

    def backward(self, x, grad):
        if not self.params:
            return grad * self.df(x), []
        h, w = 1e-6, self.params[0]
        dx = (self.f(x + h, w) - self.f(x - h, w)) / (2 * h)
        dw = np.zeros_like(w)
        for i in np.ndindex(*w.shape) if w.shape else [()]:
            e = np.zeros_like(w)
            e[i] = h
            dw[i] = (grad * (self.f(x, w + e) - self.f(x, w - e)) / (2 * h)).sum()
        return grad * dx, [dw]

    def size(self):
        return (self.n,), (self.n,)


class ReplicatorLayer(ScalarFunctionLayer):
    def __init__(self, n: int):
        super().__init__(n, identity)


class GroupedLayer(Layer):
    """Branches side by side over slices of the input."""

    def __init__(self, layers: list[Layer]):
        self.layers = layers

    @property
    def params(self):
        return [p for layer in self.layers for p in layer.params]

    def set_params(self, params):
        at = 0
        for layer in self.layers:
            n = len(layer.params)
            layer.set_params(params[at : at + n])
            at += n

    def random_init(self, rng):
        for layer in self.layers:
            layer.random_init(rng)

    def _cuts(self, which: int) -> np.ndarray:
        return np.cumsum([int(np.prod(layer.size()[which])) for layer in self.layers])[:-1]

    def forward(self, x):
        return np.concatenate([layer.forward(part) for layer, part in zip(self.layers, np.split(x, self._cuts(0), axis=1), strict=True)], axis=1)

    def backward(self, x, grad):
        got = [layer.backward(p, g) for layer, p, g in zip(self.layers, np.split(x, self._cuts(0), axis=1), np.split(grad, self._cuts(1), axis=1), strict=True)]
        return np.concatenate([dx for dx, _ in got], axis=1), [d for _, ds in got for d in ds]

    def size(self):
        return tuple((int(sum(np.prod(layer.size()[k]) for layer in self.layers)),) for k in (0, 1))


class ReshaperLayer(Layer):
    """Column-major reshape of each row."""

    def __init__(self, size_in: tuple[int, ...], size_out: tuple[int, ...] | None = None):
        self.size_in, self.size_out = tuple(size_in), tuple(size_out or (int(np.prod(size_in)),))

    @staticmethod
    def _turn(x, size):
        n = len(x)
        flat = x.reshape(n, -1) if x.ndim == 2 else np.transpose(x, (0, *range(x.ndim - 1, 0, -1))).reshape(n, -1)
        return flat if len(size) == 1 else np.transpose(flat.reshape(n, *size[::-1]), (0, *range(len(size), 0, -1)))

    def forward(self, x):
        return self._turn(x, self.size_out)

    def backward(self, x, grad):
        return self._turn(grad, self.size_in), []

    def size(self):
        return self.size_in, self.size_out


def _pads(size: Sequence[int], kernel: Sequence[int], stride: Sequence[int]) -> tuple[list[int], list[int]]:
    """Padding that keeps ceil(size / stride) places; the odd one is at the start."""
    start, end = [], []
    for s, k, t in zip(size, kernel, stride, strict=True):
        need = max(0, (math.ceil(s / t) - 1) * t + k - s)
        start.append(math.ceil(need / 2))
        end.append(need // 2)
    return start, end


class _Windows(Layer):
    """Shared by convolution and pooling: for each output place the flat input places of its window (-1 outside)."""

    def _set(self, input_size, kernel, stride, padding):
        self.input_size, self.kernel, self.stride = tuple(input_size), tuple(kernel), tuple(stride)
        a, b = padding or _pads(input_size, kernel, stride)
        self.out = tuple(1 + (s + p + q - k) // t for s, p, q, k, t in zip(input_size, a, b, kernel, stride, strict=True))
        grids = np.stack(np.meshgrid(*[np.arange(o) for o in self.out], indexing="ij"), -1).reshape(-1, len(self.out))
        inner = np.stack(np.meshgrid(*[np.arange(k) for k in kernel], indexing="ij"), -1).reshape(-1, len(self.out))
        place = grids[:, None] * np.array(stride) - np.array(a) + inner[None]
        inside = ((place >= 0) & (place < np.array(input_size))).all(-1)
        self.index = np.where(inside, np.ravel_multi_index(tuple(np.clip(place, 0, np.array(input_size) - 1).transpose(2, 0, 1)), input_size), -1)

    def _gather(self, x: np.ndarray, outside: float) -> np.ndarray:
        """rows x out places x window x channels."""
        flat = x.reshape(len(x), int(np.prod(self.input_size)), -1)
        return np.where((self.index >= 0)[None, :, :, None], flat[:, np.maximum(self.index, 0)], outside)

    def _scatter(self, n: int, grad: np.ndarray) -> np.ndarray:
        out = np.zeros((n, int(np.prod(self.input_size)) + 1, grad.shape[-1]))
        np.add.at(out, (slice(None), self.index), grad)  # -1 is the spare place
        return out[:, :-1]


class ConvLayer(_Windows):
    """Convolution in any number of dimensions, channels last."""

    def __init__(self, input_size, kernel_size, n_in: int, n_out: int, stride=None, padding=None, f: Callable = identity, df: Callable | None = None, w=None, wb=None, seed: int = 123):
        self._set(input_size, kernel_size, stride or (1,) * len(input_size), padding)
        rng, fan = np.random.default_rng(seed), int(np.prod(kernel_size))
        bound = math.sqrt(6) / math.sqrt(fan * (n_in + n_out))
        self.params = [rng.uniform(-bound, bound, (*kernel_size, n_in, n_out)) if w is None else np.asarray(w, float), rng.uniform(-bound, bound, n_out) if wb is None else np.asarray(wb, float)]
        self.n_in, self.n_out, self.f, self.df = n_in, n_out, f, df or derivative_of(f)

    def _z(self, x):
        self._seen = self._gather(x, 0.0).reshape(len(x), len(self.index), -1)
        return self._seen @ self.params[0].reshape(-1, self.n_out) + self.params[1]

    def forward(self, x):
        return self.f(self._z(x)).reshape(len(x), *self.out, self.n_out)

    def backward(self, x, grad):
        n = len(x)
        dz = grad.reshape(n, len(self.index), self.n_out) * self.df(self._z(x))
        dw = np.einsum("npi,npo->io", self._seen, dz).reshape(self.params[0].shape)
        back = (dz @ self.params[0].reshape(-1, self.n_out).T).reshape(n, len(self.index), -1, self.n_in)
        return self._scatter(n, back).reshape(x.shape), [dw, dz.sum((0, 1))]

    def size(self):
        return (*self.input_size, self.n_in), (*self.out, self.n_out)


class PoolingLayer(_Windows):
    """Maximum or mean of windows, channel by channel; padding does not count."""

    def __init__(self, input_size, kernel_size, n_channels: int, stride=None, padding=None, f: str = "max"):
        self._set(input_size, kernel_size, stride or kernel_size, padding)
        self.channels, self.f, self.params = n_channels, f, []

    def forward(self, x):
        got = self._gather(x, -np.inf if self.f == "max" else np.nan)
        return (got.max(2) if self.f == "max" else np.nanmean(got, 2)).reshape(len(x), *self.out, self.channels)

    def backward(self, x, grad):
        got = self._gather(x, -np.inf)
        if self.f == "max":
            share = (np.arange(got.shape[2])[None, None, :, None] == got.argmax(2)[:, :, None]).astype(float)
        else:
            share = ((self.index >= 0) / np.maximum((self.index >= 0).sum(1, keepdims=True), 1))[None, :, :, None] * np.ones_like(got)
        return self._scatter(len(x), share * grad.reshape(len(x), len(self.index), 1, self.channels)).reshape(x.shape), []

    def size(self):
        return (*self.input_size, self.channels), (*self.out, self.channels)


# ---------------------------------------------------------------- networks

#: Rows that losses and epochs take up at once.
BLOCK_ROWS = 65_536


@dataclass
class Network:
    layers: list[Layer]
    cost: Callable = squared_cost
    dcost: Callable | None = None
    name: str = "Neural Network"

    def __post_init__(self):
        self.dcost = self.dcost or COST_DERIVATIVES[self.cost]

    def predict(self, x: np.ndarray) -> np.ndarray:
        for layer in self.layers:
            x = layer.forward(x)
        return x

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        if len(x) <= BLOCK_ROWS:
            return float(np.mean(self.cost(y, self.predict(x))))
        parts = [np.asarray(self.cost(y[i : i + BLOCK_ROWS], self.predict(x[i : i + BLOCK_ROWS]))) for i in range(0, len(x), BLOCK_ROWS)]
        return float(sum(p.sum() for p in parts) / sum(p.size for p in parts))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> list[list[np.ndarray]]:
        """Sum over the batch, a list of arrays a layer."""
        seen = [x]
        for layer in self.layers:
            seen.append(layer.forward(seen[-1]))
        grad, out = self.dcost(y, seen[-1]), []
        for layer, before in zip(self.layers[::-1], seen[-2::-1], strict=True):
            grad, dw = layer.backward(before, grad)
            out.append(dw)
        return out[::-1]

    def get_params(self) -> list[list[np.ndarray]]:
        return [layer.get_params() for layer in self.layers]

    def set_params(self, params: list[list[np.ndarray]]) -> None:
        for layer, p in zip(self.layers, params, strict=True):
            layer.set_params(p)

    def n_params(self) -> int:
        return sum(layer.n_params() for layer in self.layers)

    def random_init(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        for layer in self.layers:
            layer.random_init(rng)

    def __getitem__(self, i) -> Network:
        return Network(self.layers[i] if isinstance(i, slice) else [self.layers[k] for k in i], self.cost, self.dcost, self.name)


class Optimiser:
    """Base of optimisers: ``start`` before training, ``update`` a step."""

    def start(self, params: list[list[np.ndarray]]) -> None:
        pass

    def update(self, params, grads, epoch: int, batch: int, n_batches: int):
        raise NotImplementedError


@dataclass
class SGD(Optimiser):
    eta: Callable[[int], float] = lambda t: 1 / (1 + t)
    multiplicative: float = 2.0

    def update(self, params, grads, epoch, batch, n_batches):
        k = self.eta(epoch) * self.multiplicative
        return [[p - k * g for p, g in zip(ps, gs, strict=True)] for ps, gs in zip(params, grads, strict=True)]


@dataclass
class ADAM(Optimiser):
    eta: Callable[[int], float] = lambda t: 0.001
    multiplicative: float = 1.0
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8

    def start(self, params):
        if not (0 < self.beta1 < 1 and 0 < self.beta2 < 1):
            raise ValueError("beta1 and beta2 are between 0 and 1")
        self.m = [[np.zeros_like(p) for p in ps] for ps in params]
        self.v = [[np.zeros_like(p) for p in ps] for ps in params]

    def update(self, params, grads, epoch, batch, n_batches):
        t, k, out = (epoch - 1) * n_batches + batch, self.eta(epoch) * self.multiplicative, []
        for i, (ps, gs) in enumerate(zip(params, grads, strict=True)):
            row = []
            for j, (p, g) in enumerate(zip(ps, gs, strict=True)):
                self.m[i][j] = self.beta1 * self.m[i][j] + (1 - self.beta1) * g
                self.v[i][j] = self.beta2 * self.v[i][j] + (1 - self.beta2) * g * g
                row.append(p - k * (self.m[i][j] / (1 - self.beta1**t)) / (np.sqrt(self.v[i][j] / (1 - self.beta2**t)) + self.epsilon))
            out.append(row)
        return out


def fitting_info(nn: Network, x, y, *, epoch: int, epochs: int, loss: float) -> bool:
    """The default callback; one that returns True stops the training."""
    if epoch == 1 or epoch == epochs or epoch % max(1, epochs // 10) == 0:
        log.info("epoch %d of %d: loss %.6g", epoch, epochs, loss)
    return False


def train_epoch(nn: Network, opt: Optimiser, x: np.ndarray, y: np.ndarray, epoch: int, batch_size: int, shuffle: bool, rng: np.random.Generator) -> None:
    n = len(x)
    size = min(batch_size, n)
    order = rng.permutation(n) if shuffle else np.arange(n)
    n_batches = n // size
    step = _dense_step(nn, opt) if type(opt) is ADAM and all(type(layer) in (DenseLayer, DenseNoBiasLayer) for layer in nn.layers) else None
    held = max(1, BLOCK_ROWS // size) * size
    for at in range(0, n_batches * size, held):  # what does not fill a batch waits for another order
        rows = order[at : min(at + held, n_batches * size)]
        xs, ys = x[rows], y[rows]
        for i in range(0, len(rows), size):
            b, bx, by = (at + i) // size + 1, xs[i : i + size], ys[i : i + size]
            if step:
                step(bx, by, epoch, b, n_batches)
                continue
            grads = [[g / size for g in gs] for gs in nn.gradient(bx, by)]
            nn.set_params(opt.update(nn.get_params(), grads, epoch, b, n_batches))


def _flat(arrays: list[list[np.ndarray]]) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """The arrays in one vector, and as views of it."""
    whole = np.concatenate([a.ravel() for row in arrays for a in row])
    views, at = [], 0
    for row in arrays:
        views.append([])
        for a in row:
            views[-1].append(whole[at : at + a.size].reshape(a.shape))
            at += a.size
    return whole, views


def _dense_step(nn: Network, opt: ADAM) -> Callable:
    """A step of ADAM on dense layers: what ``gradient`` and ``update`` do, on one vector in place, each layer's sums computed once."""
    params, views = _flat(nn.get_params())
    grads, into = _flat([[np.zeros_like(p) for p in ps] for ps in views])
    (m, opt.m), (v, opt.v) = _flat(opt.m), _flat(opt.v)
    a, b = np.empty_like(params), np.empty_like(params)
    for layer, ps in zip(nn.layers, views, strict=True):
        layer.params = ps
    layers = [(ps[0], ps[0].T, ps[1] if len(ps) > 1 else None, gs[0], gs[1] if len(gs) > 1 else None, layer.f, layer.df) for layer, ps, gs in zip(nn.layers, views, into, strict=True)]
    known = [f is relu and df is DERIVATIVES[relu] for *_, f, df in layers], [f is identity and df is DERIVATIVES[identity] for *_, f, df in layers]
    last = len(layers) - 1

    def step(x: np.ndarray, y: np.ndarray, epoch: int, batch: int, n_batches: int) -> None:
        seen, sums = [x], []
        for i, (_, wt, wb, _, _, f, _) in enumerate(layers):
            z = seen[-1] @ wt
            if wb is not None:
                z += wb
            sums.append(z)
            seen.append(z if known[1][i] else np.maximum(z, 0.0) if known[0][i] else f(z))
        dz = nn.dcost(y, seen[-1])
        for i in range(last, -1, -1):
            w, _, wb, dw, db, _, df = layers[i]
            if known[0][i]:
                dz = dz * (sums[i] > 0)
            elif not known[1][i]:
                dz = dz * df(sums[i])
            np.matmul(dz.T, seen[i], out=dw)
            if wb is not None:
                np.add.reduce(dz, 0, out=db)
            if i:
                dz = dz @ w
        t, k = (epoch - 1) * n_batches + batch, opt.eta(epoch) * opt.multiplicative
        np.divide(grads, len(x), out=grads)
        np.multiply(m, opt.beta1, out=m)
        np.multiply(grads, 1 - opt.beta1, out=a)
        np.add(m, a, out=m)
        np.multiply(v, opt.beta2, out=v)
        np.multiply(grads, 1 - opt.beta2, out=a)
        np.multiply(a, grads, out=a)
        np.add(v, a, out=v)
        np.divide(v, 1 - opt.beta2**t, out=b)
        np.sqrt(b, out=b)
        np.add(b, opt.epsilon, out=b)
        np.divide(m, 1 - opt.beta1**t, out=a)
        np.multiply(a, k, out=a)
        np.divide(a, b, out=a)
        np.subtract(params, a, out=params)

    return step


def train(nn: Network, x: np.ndarray, y: np.ndarray, *, epochs: int = 100, batch_size: int = 32, shuffle: bool = True, opt: Optimiser | None = None, seed: int = 123, callback: Callable = fitting_info, onfail: str = "continue", fail_epoch: int = 5, fail_epoch_ref: int = 2, fail_threshold: float = 0.01, first_epoch: int = 1) -> tuple[list[float], bool]:
    """Train on arrays in memory; the losses (before training, then after each epoch) and whether it did not fail."""
    opt, rng = opt or ADAM(), np.random.default_rng(seed)
    for layer in nn.layers:
        layer.preprocess()
    opt.start(nn.get_params())
    losses, ok = [nn.loss(x, y)], True
    for k in range(1, epochs + 1):
        train_epoch(nn, opt, x, y, first_epoch - 1 + k, batch_size, shuffle, rng)
        losses.append(nn.loss(x, y))
        if callback(nn, x, y, epoch=k, epochs=epochs, loss=losses[-1]):
            break
        if k == fail_epoch and losses[fail_epoch_ref] and (losses[fail_epoch_ref] - losses[k]) / losses[fail_epoch_ref] < fail_threshold:
            ok = False
            if onfail == "error":
                raise RuntimeError("the loss does not fall")
            if onfail in ("stop", "retry"):
                break
        if math.isnan(losses[-1]):
            ok = False
            break
    return losses, ok


# ---------------------------------------------------------------- estimators


@dataclass
class NNOptions(Options):
    cb: Callable = fitting_info
    onfail: str = "retry"  # error, stop, retry, continue
    fail_epoch_ref: int = 2
    fail_epoch: int = 5
    fail_threshold: float = 0.01
    fail_attempts: int = 10


@dataclass
class NNHyper:
    layers: list[Layer] | None = None
    loss: Callable = squared_cost
    dloss: Callable | None = None
    epochs: int = 200
    batch_size: int = 16
    opt_alg: Optimiser = field(default_factory=ADAM)
    shuffle: bool = True
    parallel: int = 1
    max_rows: int | None = None  # refuse more in one task
    tunemethod: Any = None


def default_width(d: int, n_out: int, probabilities: bool) -> int:
    inner = d * 2 if d <= 4 else d * 1.5
    if n_out > 1 and not probabilities:
        inner = inner * n_out / 1.5 if n_out < 5 else 1.3 * d * n_out / 3 if n_out < 10 else 1.3 * d * math.log2(n_out)
    return max(1, round(inner))


class NeuralNetworkEstimator(Model):
    """Targets are one column or several; a further fit goes on from the weights."""

    Hyper = NNHyper
    OptionsType = NNOptions
    supervised = True
    online = True

    def _network(self, df: DataFrame, columns: list[str], targets: list[str]) -> Network:
        h, d, k = self.hpar, len(columns), len(targets)
        if h.layers:
            layers = copy.deepcopy(h.layers)
            if int(np.prod(layers[0].size()[0])) != d or int(np.prod(layers[-1].size()[1])) != k:
                raise ValueError("the layers do not fit the numbers of columns and targets")
            return Network(layers, h.loss, h.dloss)
        total = sum((F.col(t).cast("double") for t in targets[1:]), F.col(targets[0]).cast("double"))
        low, ones = df.agg(F.least(*[F.min(F.col(t)) for t in targets]) if k > 1 else F.min(targets[0]), F.bool_and(F.abs(total - 1) < 1e-9)).first()
        probabilities = k > 1 and low >= 0 and bool(ones)
        w, s = default_width(d, k, probabilities), self.opt.seed
        last = [DenseLayer(w, k, identity if low < 0 else relu, seed=s + 2)]
        if probabilities:
            last.append(VectorFunctionLayer(k, softmax))
        return Network([DenseLayer(d, w, relu, seed=s), DenseLayer(w, w, relu, seed=s + 1), *last], h.loss, h.dloss)

    def _fit(self, df: DataFrame, columns: Sequence[str], targets: str | Sequence[str], id_col: str = "_id") -> None:
        columns, targets = list(columns), [targets] if isinstance(targets, str) else list(targets)
        h, o = self.hpar, self.opt
        old = self.par
        nn = old["nn"] if old else self._network(df, columns, targets)
        rows = df.select(F.col(id_col).alias("_id"), vector(columns).alias("x"), vector(targets).alias("y"))
        n, done = df.count(), self._info.get("nepochs", 0)
        if h.max_rows is not None and n > h.max_rows and h.parallel < 2:
            raise ValueError(f"{n} rows are too many for one task; set parallel, or raise max_rows")
        losses: list[float] = []
        for attempt in range(o.fail_attempts if o.onfail == "retry" and not old else 1):
            if attempt:
                nn.random_init(o.seed + 10 * attempt)
            losses, ok, params = self._run(rows, nn, done + 1, o.seed + attempt)
            nn.set_params(params)
            if ok or o.onfail != "retry":
                break
        self.par = {"nn": nn, "columns": columns, "targets": targets}
        self._info = {"nepochs": done + len(losses) - 1, "loss_per_epoch": self._info.get("loss_per_epoch", []) + losses, "final_loss": losses[-1], "xndims": len(columns), "yndims": len(targets), "fitted_records": n, "par_per_epoch": []}

    def _run(self, rows: DataFrame, nn: Network, first: int, seed: int):
        h, o = self.hpar, self.opt
        settings = dict(epochs=h.epochs, batch_size=h.batch_size, shuffle=h.shuffle, opt=h.opt_alg, seed=seed, callback=o.cb, onfail=("continue" if first > 1 else "stop") if o.onfail == "retry" else o.onfail, fail_epoch=o.fail_epoch, fail_epoch_ref=o.fail_epoch_ref, fail_threshold=o.fail_threshold, first_epoch=first)

        def arrays(batches):
            """Inputs and targets of a sorted part, as arrays over files: pages that were read can leave memory again."""
            files, widths, n = [tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) for _ in "xy"], [1, 1], 0
            for batch in batches:
                for i, name in enumerate("xy" if len(batch) else ""):
                    flat = np.asarray(batch.column(name).flatten().to_numpy(zero_copy_only=False), float)
                    widths[i] = len(flat) // len(batch)
                    files[i].write(flat.tobytes())
                n += len(batch)
            if not n:
                return (np.zeros((0, 1)),) * 2
            for f in files:
                f.flush()
            return tuple(np.memmap(f, float, "r", shape=(n, w)) for f, w in zip(files, widths, strict=True))

        def packed(*got):
            return pa.RecordBatch.from_pydict({"blob": [pickle.dumps(got)]})

        shapes = nn.layers[0].size()[0]

        def shaped(x):
            return x.reshape(len(x), *shapes) if len(shapes) > 1 else x

        if h.parallel < 2:

            def once(batches):
                x, y = arrays(batches)
                if len(x):
                    losses, ok = train(nn, shaped(x), y, **settings)
                    yield packed(losses, ok, nn.get_params())

            got = rows.coalesce(1).sortWithinPartitions("_id").mapInArrow(once, "blob binary").collect()
            return pickle.loads(bytes(got[0]["blob"]))
        dealt = rows.repartition(h.parallel, "_id").sortWithinPartitions("_id").persist()
        losses: list[float] = []
        ok = True
        try:
            for k in range(h.epochs):
                held = rows.sparkSession.sparkContext.broadcast(nn.get_params())

                def part(batches, held=held, k=k):
                    x, y = arrays(batches)
                    if len(x):
                        net = copy.deepcopy(nn)
                        net.set_params(held.value)
                        before = net.loss(shaped(x), y)
                        opt = copy.deepcopy(h.opt_alg)
                        opt.start(net.get_params())
                        train_epoch(net, opt, shaped(x), y, first + k, h.batch_size, h.shuffle, np.random.default_rng(seed + k))
                        yield packed(len(x), before, net.get_params())

                got = [pickle.loads(bytes(r["blob"])) for r in dealt.mapInArrow(part, "blob binary").collect()]
                whole = sum(n for n, _, _ in got)
                losses.append(sum(n * a for n, a, _ in got) / whole)
                nn.set_params([[sum(n * p[i][j] for n, _, p in got) / whole for j in range(len(ps))] for i, ps in enumerate(nn.get_params())])
        finally:
            dealt.unpersist()
        return losses, ok and not math.isnan(losses[-1]), nn.get_params()

    def _transform(self, df: DataFrame) -> DataFrame:
        single = len(self.par["targets"]) == 1
        out = score(df, self.par["nn"], self.par["columns"], "prediction")
        return out.withColumn("prediction", F.get("prediction", F.lit(0))) if single else out


def score(df: DataFrame, nn: Network, columns: Sequence[str], out: str) -> DataFrame:
    """The network's output as array<double>, by batches."""
    # the network's own size; functions of the user may be lambdas, so it is pickled by value
    held, shape = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(nn)), nn.layers[0].size()[0]

    def run(x: pd.Series) -> pd.Series:
        net = pickle.loads(held.value)
        rows = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, int(np.prod(shape))))
        got = net.predict(rows.reshape(len(rows), *shape) if len(shape) > 1 else rows)
        return pd.Series(list(got.reshape(len(rows), -1)))

    return df.withColumn(out, F.pandas_udf(run, "array<double>")(vector(columns)))


@dataclass
class AutoEncoderHyper:
    encoded_size: float = 0.333
    layers_size: float | None = None
    e_layers: list[Layer] | None = None
    d_layers: list[Layer] | None = None
    loss: Callable = squared_cost
    dloss: Callable | None = None
    epochs: int = 200
    batch_size: int = 8
    opt_alg: Optimiser = field(default_factory=ADAM)
    shuffle: bool = True
    parallel: int = 1
    max_rows: int | None = None  # refuse more in one task
    tunemethod: Any = None


class AutoEncoder(NeuralNetworkEstimator):
    """A network that learns its input; ``transform`` gives the code, ``inverse_transform`` the input again."""

    Hyper = AutoEncoderHyper
    supervised = False

    def _fit(self, df: DataFrame, columns: Sequence[str], id_col: str = "_id") -> None:
        h, d, s = self.hpar, len(columns), self.opt.seed
        code = int(h.encoded_size) if h.encoded_size >= 1 else max(1, round(d * h.encoded_size))
        inner = 3 if d == 1 else d**2 if d < 5 else 1.3 * d * d / 3 if d < 10 else 1.3 * d * math.log2(d)
        inner = max(1, round(inner if h.layers_size is None else h.layers_size if h.layers_size >= 1 else d * h.layers_size))
        e = copy.deepcopy(h.e_layers) or [DenseLayer(d, inner, relu, seed=s), DenseLayer(inner, inner, relu, seed=s + 1), DenseLayer(inner, code, identity, seed=s + 2)]
        g = copy.deepcopy(h.d_layers) or [DenseLayer(code, inner, relu, seed=s + 3), DenseLayer(inner, inner, relu, seed=s + 4), DenseLayer(inner, d, identity, seed=s + 5)]
        if self.par is None:
            self.par = {"nn": Network([*e, *g], h.loss, h.dloss), "columns": list(columns), "targets": list(columns)}
            self._cut = len(e)
        super()._fit(df, columns, list(columns), id_col)
        again = score(df, self.par["nn"], columns, "_again")
        x = vector(columns)
        gap = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v))
        top, low = again.agg(F.sum(gap(F.zip_with("_again", x, lambda a, b: a - b))), F.sum(gap(x))).first()
        self._info["rme"] = top / low if low else float("nan")

    def _transform(self, df: DataFrame) -> DataFrame:
        return score(df, self.par["nn"][: self._cut], self.par["columns"], "encoded")

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        size = int(np.prod(self.par["nn"].layers[self._cut].size()[0]))
        names = [f"_e{i}" for i in range(size)]
        rows = df.withColumns({n: F.get("encoded", F.lit(i)) for i, n in enumerate(names)})
        return score(rows, self.par["nn"][self._cut :], names, "decoded").drop(*names)
