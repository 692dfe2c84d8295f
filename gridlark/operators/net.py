"""Small networks fitted by gradient descent: Spark sums the gradients over all rows, prediction is an expression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of layers: what a hidden value becomes, as an expression and as numbers, and its slope from that.
KINDS = {
    "tanh": (F.tanh, np.tanh, lambda a: 1 - a**2),
    "relu": (lambda c: F.greatest(c, F.lit(0.0)), lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)),
    "sigmoid": (lambda c: 1 / (1 + F.exp(-c)), lambda z: 1 / (1 + np.exp(-z)), lambda a: a * (1 - a)),
    "linear": (lambda c: c, lambda z: z, np.ones_like),
}


@dataclass(frozen=True)
class Network:
    """Layers of weights, the last row of each the biases; the last layer is linear."""

    features: tuple[str, ...]
    layers: tuple[np.ndarray, ...]
    kind: str = "tanh"
    loss: float = float("nan")

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """The input and what each layer makes of it."""
        out = [x]
        for k, w in enumerate(self.layers):
            z = out[-1] @ w[:-1] + w[-1]
            out.append(KINDS[self.kind][1](z) if k < len(self.layers) - 1 else z)
        return out

    def back(self, values: list[np.ndarray], g: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Gradients of the layers, and of the input, from that of the output."""
        grads = []
        for k in reversed(range(len(self.layers))):
            if k < len(self.layers) - 1:
                g = g * KINDS[self.kind][2](values[k + 1])
            grads.append(np.vstack([values[k].T @ g, g.sum(axis=0)]))
            g = g @ self.layers[k][:-1].T
        return grads[::-1], g

    def expression(self) -> Column:
        """The prediction for a row, without Python; null if a feature is."""
        now = [F.col(f"`{c}`") for c in self.features]
        for k, w in enumerate(self.layers):
            z = [sum((now[i] * float(w[i, j]) for i in range(len(now))), F.lit(float(w[-1, j]))) for j in range(w.shape[1])]
            now = [KINDS[self.kind][0](c) for c in z] if k < len(self.layers) - 1 else z
        return now[0]

    def back_project(self, start: np.ndarray, steps: int = 20, rate: float = 0.1) -> np.ndarray:
        """The input after climbing the output's gradient for some steps."""
        x = np.array(start, float)[None, :]
        for _ in range(steps):
            x = x + rate * self.back(self.forward(x), np.ones((1, 1)))[1]
        return x[0]


def train(df: DataFrame, features: list[str], target: str, hidden: tuple[int, ...] = (16,), kind: str = "tanh", restarts: int = 4, epochs: int = 200, rate: float = 0.1, momentum: float = 0.9, validation: float = 0.2, seed: int = 0) -> Network:
    """The best of several seeded restarts by loss on rows set aside.

    Gradient descent with momentum on the mean squared error of all rows. An
    epoch is a job: each task sums the gradients of its rows for all restarts
    and sends one row a restart and weight, which Spark adds; nothing but these sums
    reaches the driver. Rows with missing values teach nothing; without rows
    an error is raised. Repeated rows count as often as they occur.
    """
    names = [f"x{i}" for i in range(len(features))]
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(features, names, strict=True)], F.col(f"`{target}`").cast("double").alias("y")).dropna()
    held = F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(1000)) < int(1000 * validation)
    rows = rows.withColumn("held", held).persist()
    sizes = [len(features), *hidden, 1]
    rngs = [np.random.default_rng([seed, k]) for k in range(restarts)]
    nets = [[np.vstack([r.normal(0, 1 / np.sqrt(a), (a, b)), np.zeros(b)]) for a, b in zip(sizes, sizes[1:], strict=False)] for r in rngs]
    speed = [[np.zeros_like(w) for w in net] for net in nets]
    best = [(np.inf, net) for net in nets]

    def sums(nets: list) -> np.ndarray:
        """By restart: rows, their squared errors, held rows, their squared errors, and gradients."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                x = np.column_stack([batch.column(k).to_numpy() for k in range(len(names))])
                y, away = batch.column(len(names)).to_numpy()[:, None], batch.column(len(names) + 1).to_numpy(zero_copy_only=False)
                out = []
                for net in nets:
                    network = Network((), tuple(net), kind)
                    values = network.forward(x)
                    error = values[-1] - y
                    grads, _ = network.back(values, np.where(away[:, None], 0.0, 2 * error))
                    out.append(np.concatenate([[(~away).sum(), (error[~away] ** 2).sum(), away.sum(), (error[away] ** 2).sum()], *[g.ravel() for g in grads]]))
                total = total + np.array(out)
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array(range(len(nets)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["restart", "v"])

        found = rows.mapInArrow(run, "restart int, v array<double>").select("restart", F.posexplode("v").alias("i", "v")).groupBy("restart", "i").agg(F.sum("v").alias("v"))
        out = np.zeros((len(nets), 4 + sum(w.size for w in nets[0])))
        for r in found.collect():
            out[r["restart"], r["i"]] = r["v"]
        return out

    for epoch in range(epochs + 1):
        found = sums(nets)
        if not found[0, 0] + found[0, 2]:
            raise ValueError("there are no complete rows")
        for k, (n, squares, n_held, held_squares) in enumerate(found[:, :4]):
            loss = held_squares / n_held if n_held else squares / max(1, n)
            best[k] = min(best[k], (float(loss), [w.copy() for w in nets[k]]), key=lambda b: b[0])
            at = 4
            for j, w in enumerate(nets[k]):
                g = found[k, at : at + w.size].reshape(w.shape) / max(1, n)
                speed[k][j] = momentum * speed[k][j] - rate * g
                nets[k][j] = w + speed[k][j]
                at += w.size
    rows.unpersist()
    loss, layers = min(best, key=lambda b: b[0])
    return Network(tuple(features), tuple(layers), kind, loss)


def predict(df: DataFrame, network: Network, name: str = "prediction") -> DataFrame:
    """All columns and the network's output."""
    return df.withColumn(name, network.expression())
