"""Feed-forward and convolutional networks: weights on the driver, per-partition sums of loss, gradient and Gauss-Newton products on the executors.

A layer maps rows of activations; a full layer has a bias and tanh, the output layer a bias and softmax (or identity). A convolution layer
slides one kernel with a bias over the square plane, takes tanh, then averages windows with two parameters for a plane.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnmill.plans.session import ensure_package


def window_index(side: int, window: int, step: int = 1, pad: int = 0) -> np.ndarray:
    """(places, window^2): which unit of a flattened square plane each window place holds; -1 outside."""
    n = (side + 2 * pad - window) // step + 1
    r = np.arange(n) * step - pad
    rows = (r[:, None, None, None] + np.arange(window)[None, None, :, None])
    cols = (r[None, :, None, None] + np.arange(window)[None, None, None, :])
    index = np.where((rows >= 0) & (rows < side) & (cols >= 0) & (cols < side), rows * side + cols, -1)
    return index.reshape(n * n, window * window)


def inverse_index(index: np.ndarray, n_units: int) -> list[np.ndarray]:
    """For each unit, the flat places of the index that read it."""
    flat = index.ravel()
    return [np.flatnonzero(flat == u) for u in range(n_units)]


@dataclass(frozen=True)
class Full:
    n_in: int
    n_out: int
    activation: str = "tanh"

    @property
    def size(self) -> int:
        return (self.n_in + 1) * self.n_out

    def forward(self, w, x):
        w = w.reshape(self.n_out, self.n_in + 1)
        z = x @ w[:, 1:].T + w[:, 0]
        return np.tanh(z) if self.activation == "tanh" else z

    def backward(self, w, x, out, g):
        """Gradient by the weights and by the input, from that by the output."""
        w = w.reshape(self.n_out, self.n_in + 1)
        g = g * (1 - out * out) if self.activation == "tanh" else g
        return np.concatenate([g.sum(0)[:, None], g.T @ x], axis=1).ravel(), g @ w[:, 1:]


@dataclass(frozen=True)
class Convolution:
    side: int
    kernel: int
    planes: int
    pool: int

    @property
    def n_out(self) -> int:
        return self.planes * (((self.side - self.kernel + 1) - self.pool) // self.pool + 1) ** 2

    @property
    def size(self) -> int:
        return self.planes * (self.kernel**2 + 1 + 2)

    def forward(self, w, x, inner=False):
        w = w.reshape(self.planes, -1)
        k2 = self.kernel**2
        patches = x[:, window_index(self.side, self.kernel)]
        a = np.tanh(np.einsum("npk,ck->ncp", patches, w[:, 1 : k2 + 1]) + w[None, :, :1])
        means = a[:, :, window_index(self.side - self.kernel + 1, self.pool, self.pool)].mean(-1)
        out = np.tanh(means * w[None, :, k2 + 1 : k2 + 2] + w[None, :, k2 + 2 : k2 + 3])
        return (out.reshape(len(x), -1), patches, a, means) if inner else out.reshape(len(x), -1)

    def backward(self, w, x, out, g):
        w = w.reshape(self.planes, -1)
        k2 = self.kernel**2
        out, patches, a, means = self.forward(w, x, True)
        gz = (g * (1 - out * out)).reshape(means.shape)
        gm = gz * w[None, :, k2 + 1 : k2 + 2] / self.pool**2
        ga = np.zeros_like(a)
        index = window_index(self.side - self.kernel + 1, self.pool, self.pool)
        ga[:, :, index.ravel()] = np.repeat(gm, self.pool**2, axis=2)
        ga *= 1 - a * a
        gw = np.concatenate([ga.sum((0, 2))[:, None], np.einsum("ncp,npk->ck", ga, patches), (gz * means).sum((0, 2))[:, None], gz.sum((0, 2))[:, None]], axis=1)
        return gw.ravel(), None  # a convolution comes first, so nothing is below it


@dataclass(frozen=True)
class Network:
    layers: tuple
    regression: bool = False

    @property
    def size(self) -> int:
        return sum(layer.size for layer in self.layers)

    def start(self, seed: int = 0) -> np.ndarray:
        return np.random.default_rng(seed).normal(0, 0.3, self.size)

    def cut(self, w):
        ends = np.cumsum([layer.size for layer in self.layers])
        return np.split(w, ends[:-1])

    def forward(self, w, x):
        for layer, part in zip(self.layers, self.cut(w), strict=True):
            x = layer.forward(part, x)
        return x

    def probabilities(self, w, x):
        z = self.forward(w, x)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def loss_gradient(self, w, x, y):
        parts, acts = self.cut(w), [x]
        for layer, part in zip(self.layers, parts, strict=True):
            acts.append(layer.forward(part, acts[-1]))
        z = acts[-1]
        if self.regression:
            g = z - y.reshape(z.shape)
            loss = 0.5 * (g * g).sum()
        else:
            top = z - z.max(axis=1, keepdims=True)
            logp = top - np.log(np.exp(top).sum(axis=1, keepdims=True))
            hit = np.eye(z.shape[1])[y.astype(int)]
            loss, g = -(logp * hit).sum(), np.exp(logp) - hit
        grads = []
        for k in range(len(self.layers) - 1, -1, -1):
            gw, g = self.layers[k].backward(parts[k], acts[k], acts[k + 1], g)
            grads.append(gw)
        return float(loss), np.concatenate(grads[::-1])


def sums(rows: DataFrame, columns: list[str], label: str, net: Network, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient over all rows: one vector for each batch, added up by Spark."""
    ensure_package(rows.sparkSession)
    size = net.size + 1

    def run(batches):
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))], 1).astype(float)
            loss, g = net.loss_gradient(w, x, b.column(len(columns)).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(range(size)), pa.array(np.append(g, loss))], names=["i", "v"])

    got = {r["i"]: r["s"] for r in rows.select(*columns, label).mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("s")).collect()}
    v = np.array([got.get(i, 0.0) for i in range(size)])
    return float(v[-1]), v[:-1]


def train(rows: DataFrame, columns: list[str], label: str, net: Network, w: np.ndarray, rounds: int = 20, inner: int = 8, tol: float = 1e-4) -> tuple[np.ndarray, list[float]]:
    """Truncated Newton: conjugate gradients on differences of gradients, and a halving line search; the losses do not rise."""
    f, g = sums(rows, columns, label, net, w)
    losses = [f]
    for _ in range(rounds):
        norm = np.linalg.norm(g)
        if norm <= tol:
            break
        s, r = np.zeros_like(w), -g
        q, rr = r.copy(), r @ r
        for _ in range(inner):
            h = 1e-4 / max(np.linalg.norm(q), 1e-12)
            hq = (sums(rows, columns, label, net, w + h * q)[1] - g) / h + 1e-3 * q
            curve = q @ hq
            if curve <= 1e-12 * (q @ q):
                s = s if s.any() else -g
                break
            a = rr / curve
            s, r = s + a * q, r - a * hq
            if r @ r <= 0.05 * norm * norm:
                break
            q, rr = r + (r @ r) / rr * q, r @ r
        size = 1.0
        for _ in range(20):
            new_f, new_g = sums(rows, columns, label, net, w + size * s)
            if new_f <= f + 1e-4 * size * (g @ s):
                break
            size /= 2
        else:
            break
        w, f, g = w + size * s, new_f, new_g
        losses.append(f)
    return w, losses


def predict(rows: DataFrame, id_col: str, columns: list[str], net: Network, w: np.ndarray) -> DataFrame:
    """(id, label, p): the most likely class and its probability."""
    ensure_package(rows.sparkSession)

    def run(batches):
        for b in batches:
            x = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(columns))], 1).astype(float)
            p = net.probabilities(w, x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.argmax(1)), pa.array(p.max(1))], names=[id_col, "label", "p"])

    return rows.select(id_col, *columns).mapInArrow(run, f"{id_col} long, label long, p double")
