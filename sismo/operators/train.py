"""Training of the dense networks that ``net`` scores: mean squared error,
Adam, mini-batches, a number of epochs, a loss per epoch on the training rows
and on the rows held out.

Rows are dealt once, by the hash of their position, into shards of about
``SHARD_ROWS`` rows; a shard is one partition and, packed, one row of a table
on the executors' disks. An epoch is one job: every shard goes through all of
its rows in an order drawn anew, in mini-batches, from the same weights; the
weights and Adam's moments are then averaged by rows (parallel SGD with
averaging). Up to ``SHARD_ROWS`` training rows there is one shard, which is
plain mini-batch training. States are added up in about as many tasks as each
then has states, so the driver gets some square root of the shards; what
travels is the size of the network, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import AE_BATCH, AE_EPOCHS, AE_LAYERS, SEED
from .net import Params

SHARD_ROWS = 1 << 17
RATE, BETA1, BETA2, EPSILON = 0.001, 0.9, 0.999, 1e-7
SCORED_AT_ONCE = 1 << 14

PACKED = "is_validation int, shard int, n long, xs binary"
SUMS = "is_validation int, shard int, n long, loss double, state binary"


def _views(vector: np.ndarray, layers: Sequence[int]) -> Params:
    """Weights and biases of the layers as views of one vector."""
    out, at = [], 0
    for a, b in zip(layers[:-1], layers[1:]):
        out.append((vector[at:at + a * b].reshape(a, b), vector[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def initial(layers: Sequence[int], seed: int = SEED) -> np.ndarray:
    """Weights uniform within sqrt(6 / (inputs + outputs)), biases 0."""
    rng = np.random.default_rng(seed)
    vector = np.zeros(sum((a + 1) * b for a, b in zip(layers[:-1], layers[1:])), np.float32)
    for w, _ in _views(vector, layers):
        limit = (6.0 / sum(w.shape)) ** 0.5
        w[...] = rng.uniform(-limit, limit, w.shape)
    return vector


def loss_and_gradient(params: Params, x: np.ndarray, grads: Params) -> float:
    """Mean squared difference between ``x`` and its reconstruction; its
    gradient is written into ``grads``."""
    hidden = [x]
    for i, (w, b) in enumerate(params):
        h = hidden[-1] @ w
        h += b
        if i < len(params) - 1:
            np.maximum(h, 0.0, out=h)
        hidden.append(h)
    d = hidden[-1] - x
    loss = float(np.square(d, dtype=np.float64).mean())
    d *= 2.0 / d.size
    for i in range(len(params) - 1, -1, -1):
        np.matmul(hidden[i].T, d, out=grads[i][0])
        d.sum(axis=0, out=grads[i][1])
        if i:
            d = d @ params[i][0].T
            d *= hidden[i] > 0.0
    return loss


def squared_error(params: Params, x: np.ndarray) -> float:
    """Sum over the rows of the mean squared difference between a row and its
    reconstruction."""
    total = 0.0
    for p in range(0, len(x), SCORED_AT_ONCE):
        h = mine = x[p:p + SCORED_AT_ONCE]
        for i, (w, b) in enumerate(params):
            h = h @ w + b
            if i < len(params) - 1:
                h = np.maximum(h, 0.0)
        total += float(np.square(h - mine, dtype=np.float64).mean(axis=1).sum())
    return total


@dataclass
class Adam:
    """A network in training: weights, the moments of their gradients, steps
    so far."""
    layers: tuple[int, ...]
    weights: np.ndarray
    m: np.ndarray
    v: np.ndarray
    step: int = 0

    @classmethod
    def of(cls, layers: Sequence[int], weights: np.ndarray) -> Adam:
        return cls(tuple(layers), weights, np.zeros_like(weights), np.zeros_like(weights))

    def vector(self) -> np.ndarray:
        return np.concatenate([self.weights, self.m, self.v, [self.step]], dtype=np.float64)

    @classmethod
    def back(cls, layers: Sequence[int], vector: np.ndarray) -> Adam:
        w, m, v = np.split(vector[:-1].astype(np.float32), 3)
        return cls(tuple(layers), w, m, v, int(round(vector[-1])))

    def epoch(self, x: np.ndarray, batch: int, rng) -> float:
        """One pass over the rows in an order of ``rng``; the sum over the
        rows of their losses, each before its batch's step."""
        params, gradient = _views(self.weights, self.layers), np.empty_like(self.weights)
        grads = _views(gradient, self.layers)
        x = x[rng.permutation(len(x))]
        total = 0.0
        for p in range(0, len(x), batch):
            mine = x[p:p + batch]
            total += loss_and_gradient(params, mine, grads) * len(mine)
            self.step += 1
            self.m += (1 - BETA1) * (gradient - self.m)
            self.v += (1 - BETA2) * (gradient * gradient - self.v)
            rate = RATE * (1 - BETA2 ** self.step) ** 0.5 / (1 - BETA1 ** self.step)
            self.weights -= rate * self.m / (np.sqrt(self.v) + EPSILON)
        return total


@dataclass
class Fit:
    """The trained network and (epoch, training loss, validation loss or
    none) of every epoch."""
    params: Params
    n_train: int
    n_validation: int
    history: list[tuple[int, float, float | None]] = field(default_factory=list)


def _batch(columns, schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(columns, kinds)], names=list(names))


def _packed(cols: list[str], idc: str):
    """One row per shard: its rows in order of position as one array."""
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches).combine_chunks()
        t = t.sort_by([("is_validation", "ascending"), ("shard", "ascending"), (idc, "ascending")])
        keys = np.stack([t.column(c).to_numpy() for c in ("is_validation", "shard")], axis=1)
        xs = np.stack([t.column(c).to_numpy().astype(np.float32) for c in cols], axis=1)
        edges = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        for p, q in zip(edges, np.append(edges[1:], len(xs))):
            yield _batch([[keys[p, 0]], [keys[p, 1]], [q - p], [xs[p:q].tobytes()]], PACKED)
    return run


def _one_epoch(sent: bytes, layers: tuple[int, ...], turn: int, batch: int, seed: int):
    """Per shard the sum of its losses: of training rows while they train,
    with the state reached; of rows held out with the weights sent."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                x = np.frombuffer(r["xs"], np.float32).reshape(-1, layers[0])
                state = Adam.back(layers, np.frombuffer(sent))
                if r["is_validation"]:
                    loss, reached = squared_error(_views(state.weights, layers), x), b""
                else:
                    loss = state.epoch(x, batch, np.random.default_rng([seed, turn, r["shard"]]))
                    reached = state.vector().tobytes()
                yield _batch([[r["is_validation"]], [r["shard"]], [r["n"]], [loss], [reached]], SUMS)
    return run


def _added(rows: list[dict]) -> list[dict]:
    """Rows, losses and states (times their rows) added up, in order of the
    shards, training and held-out ones apart."""
    out = []
    for part in (0, 1):
        mine = sorted((r for r in rows if r["is_validation"] == part), key=lambda r: r["shard"])
        if mine:
            out.append({"is_validation": part, "shard": mine[0]["shard"], "n": sum(r["n"] for r in mine), "loss": sum(r["loss"] for r in mine),
                        "state": sum(np.frombuffer(r["state"]) for r in mine)})
    return out


def _weighed(batches):
    """The sum of a task's states, each times its rows."""
    rows = [{**r, "state": (np.frombuffer(r["state"]) * r["n"]).tobytes()} for b in batches for r in b.to_pylist()]
    for r in _added(rows):
        yield _batch([[r["is_validation"]], [r["shard"]], [r["n"]], [r["loss"]], [r["state"].tobytes()]], SUMS)


def fit_autoencoder(df: DataFrame, cols: Sequence[str], layers: Sequence[int] = AE_LAYERS, epochs: int = AE_EPOCHS,
                    batch: int = AE_BATCH, flag: str = "is_validation", idc: str = "pos", seed: int = SEED,
                    shard_rows: int = SHARD_ROWS) -> Fit:
    """Trains the network to give ``cols`` back, on the rows whose ``flag``
    is 0; rows whose flag is 1 only measure it, after every epoch. Rows with
    a null feature are left out. Without training rows there is no history
    and the weights stay as drawn."""
    cols, layers = list(cols), tuple(layers)
    rows = df.dropna(subset=cols).select(F.col(flag).cast("int").alias("is_validation"), F.col(idc).cast("long").alias(idc),
                                         *[F.col(c).cast("double").alias(c) for c in cols])
    n = {r["is_validation"]: r["n"] for r in rows.groupBy("is_validation").agg(F.count(F.lit(1)).alias("n")).collect()}
    state = Adam.of(layers, initial(layers, seed))
    fit = Fit(_views(state.weights, layers), n.get(0, 0), n.get(1, 0))
    if not fit.n_train:
        return fit
    k, held = -(-fit.n_train // shard_rows), -(-fit.n_validation // shard_rows)
    here = F.when(F.col("is_validation") == 0, F.pmod(F.xxhash64(idc), F.lit(k))).otherwise(F.lit(k) + F.pmod(F.xxhash64(idc), F.lit(max(1, held))))
    shards = (rows.withColumn("shard", here.cast("int")).repartitionById(k + held, "shard")
              .mapInArrow(_packed(cols, idc), PACKED).persist(StorageLevel.DISK_ONLY))
    tasks = int(np.ceil(np.sqrt(k + held)))

    def job(some: DataFrame, turn: int) -> dict[int, dict]:
        done = some.mapInArrow(_one_epoch(state.vector().tobytes(), layers, turn, batch, seed), SUMS)
        sums = done.repartitionById(tasks, F.col("shard") % tasks).mapInArrow(_weighed, SUMS).collect()
        return {r["is_validation"]: r for r in _added([r.asDict() for r in sums])}

    losses, held_losses = [], []
    try:
        for turn in range(1, epochs + 1):
            got = job(shards, turn)     # rows held out are measured with the weights of the epoch before
            losses.append(got[0]["loss"] / got[0]["n"])
            held_losses += [got[1]["loss"] / got[1]["n"]] if 1 in got and turn > 1 else []
            state = Adam.back(layers, got[0]["state"] / got[0]["n"])
        if held:
            last = job(shards.where("is_validation = 1"), epochs + 1)
            held_losses.append(last[1]["loss"] / last[1]["n"])
    finally:
        shards.unpersist()
    fit.params = _views(state.weights, layers)
    fit.history = [(e + 1, loss, held_losses[e] if held else None) for e, loss in enumerate(losses)]
    return fit


def loss_history(spark: SparkSession, fit: Fit) -> DataFrame:
    """One row per epoch and key (``Loss``, ``Val Loss``), for a chart; no
    ``Val Loss`` without rows held out."""
    rows = [(e, fit.n_train, fit.n_validation, loss, held) for e, loss, held in fit.history]
    wide = spark.createDataFrame(rows, "epoch int, n_train long, n_validation long, `Loss` double, `Val Loss` double")
    return wide.unpivot(["epoch", "n_train", "n_validation"], ["Loss", "Val Loss"], "key", "value").where(F.col("value").isNotNull())
