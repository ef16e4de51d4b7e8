"""Scoring with small dense networks (autoencoder, latent encoder).

Weights are a list of ``(W, b)`` numpy pairs: a few thousand numbers, kept
on the driver and shipped inside the task closure (a broadcast of bounded
size). Two scoring paths:

* :func:`score_columns` — the forward pass as column expressions, one column
  per unit. Exact and JVM-side; for small nets.
* :func:`score_arrow` — ``mapInPandas`` with numpy matmuls over Arrow
  batches; for the full 4-64-32-10-32-64-4 autoencoder.

Weights come from training (``operators.train``) or a saved table
(``sources.files.load_model``). Without weights the flows fall back to MLlib
PCA (``operators.pca``), a linear autoencoder.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Params = list[tuple[np.ndarray, np.ndarray]]


# ---------------------------------------------------------------------------
# numpy core
# ---------------------------------------------------------------------------
def forward_np(params: Params, x: np.ndarray, upto: int | None = None) -> np.ndarray:
    """ReLU hidden layers, linear output; ``upto`` = number of layers to run
    (the output of layer ``upto`` is returned, activated if hidden)."""
    h = x
    n = len(params)
    stop = n if upto is None else upto
    for i in range(stop):
        w, b = params[i]
        h = h @ w + b
        if i < n - 1:
            h = np.maximum(h, 0.0)
    return h


# ---------------------------------------------------------------------------
# Scoring
# ---------------------------------------------------------------------------
def _dot(inputs: list[Column], w: np.ndarray, j: int, b: float) -> Column:
    terms = [inputs[i] * F.lit(float(w[i, j])) for i in range(len(inputs))]
    return reduce(lambda p, q: p + q, terms) + F.lit(float(b))


def _barrier(c: Column) -> Column:
    """Identity that the optimizer treats as non-deterministic, so a filter
    on a network output is not substituted down through the layer
    projections (inlined, its size would multiply by every fan-in)."""
    return F.when(F.spark_partition_id() >= F.lit(0), c)


def score_columns(df: DataFrame, params: Params, in_cols: Sequence[str], prefix: str = "h",
                  upto: int | None = None) -> DataFrame:
    """Forward pass as columns ``{prefix}{layer}_{unit}``; returns the frame
    with the last computed layer as ``{prefix}_0..``. One projection per
    layer (each unit is referenced by the next layer, so projections are
    not collapsed into duplicated expressions)."""
    n = len(params)
    stop = n if upto is None else upto
    cur = [F.col(c) for c in in_cols]
    out = df
    names: list[str] = []
    for li in range(stop):
        w, b = params[li]
        exprs = {}
        for j in range(w.shape[1]):
            z = _dot(cur, w, j, b[j])
            exprs[f"_{prefix}{li}_{j}"] = F.greatest(z, F.lit(0.0)) if li < n - 1 else z
        out = out.withColumns(exprs)
        if names:
            out = out.drop(*names)
        names = list(exprs)
        cur = [F.col(c) for c in names]
    out = out.withColumns({f"{prefix}_{j}": _barrier(F.col(c)) for j, c in enumerate(names)})
    return out.drop(*names)


def reconstruction_error_columns(df: DataFrame, params: Params, in_cols: Sequence[str],
                                 out: str = "reconstruction_error") -> DataFrame:
    """Mean squared difference between the inputs and the reconstruction
    (summed left to right, divided by the width)."""
    rec = score_columns(df, params, in_cols, prefix="r")
    sq = [(F.col(f"r_{j}") - F.col(c)) * (F.col(f"r_{j}") - F.col(c)) for j, c in enumerate(in_cols)]
    err = reduce(lambda p, q: p + q, sq) / F.lit(float(len(in_cols)))
    return rec.withColumn(out, err).drop(*[f"r_{j}" for j in range(len(in_cols))])


def score_arrow(df: DataFrame, params: Params, in_cols: Sequence[str], mode: str = "error",
                upto: int | None = None, out: str = "reconstruction_error",
                latent_prefix: str = "latent_feature_") -> DataFrame:
    """Arrow-batched numpy forward pass: only ``in_cols`` become numpy arrays,
    all other columns pass untouched.

    ``mode='error'`` adds ``out`` (per-row MSE of the reconstruction);
    ``mode='latent'`` adds ``{latent_prefix}0..`` from layer ``upto``. A row
    with a null input gets null."""
    weights = [(w.astype(np.float64), b.astype(np.float64)) for w, b in params]
    if mode == "error":
        names = [out]
    else:
        names = [f"{latent_prefix}{j}" for j in range(weights[(upto or len(weights)) - 1][0].shape[1])]
    cols = list(in_cols)
    kept = [c for c in df.columns if c not in names]

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in cols], axis=1)
            if mode == "error":
                new = np.mean((x - forward_np(weights, x)) ** 2, axis=1)[:, None]
            else:
                new = forward_np(weights, x, upto)
            old = batch.select(kept)
            yield pa.RecordBatch.from_arrays([*old.columns, *(pa.array(v, mask=np.isnan(v)) for v in new.T)], names=[*kept, *names])

    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, T.DoubleType()) for n in names)])
    return df.mapInArrow(run, schema)


def fold_scaler(params: Params, mean: Sequence[float], std: Sequence[float]) -> Params:
    """The network that takes raw features: ``(x - mean) / std`` becomes part
    of the first layer."""
    w, b = params[0]
    scaled = w / np.asarray(std, float)[:, None]
    return [(scaled, b - np.asarray(mean, float) @ scaled), *params[1:]]


def weights_table(spark, params: Params) -> DataFrame:
    """``layer, i, j, value``; biases have ``i = -1``."""
    rows = []
    for li, (w, b) in enumerate(params):
        for i in range(w.shape[0]):
            for j in range(w.shape[1]):
                rows.append((li, i, j, float(w[i, j])))
        for j in range(len(b)):
            rows.append((li, -1, j, float(b[j])))
    return spark.createDataFrame(rows, "layer int, i int, j int, value double")


def params_from_rows(rows, layers: Sequence[int]) -> Params:
    params = [(np.zeros((a, b)), np.zeros(b)) for a, b in zip(layers[:-1], layers[1:])]
    for r in rows:
        w, b = params[r["layer"]]
        if r["i"] < 0:
            b[r["j"]] = r["value"]
        else:
            w[r["i"], r["j"]] = r["value"]
    return params


def rule_params(layers: Sequence[int]) -> Params:
    """Deterministic dyadic weights for SQL-checkable scoring:
    ``w = ((7i + 3j + 5l) mod 11 - 5) / d`` with d the next power of two from
    the layer's inputs on (8 at least), ``b = ((5j + l) mod 7 - 3) / 16``."""
    out = []
    for li, (a, b) in enumerate(zip(layers[:-1], layers[1:])):
        d = float(max(8, 1 << (a - 1).bit_length()))
        w = np.array([[((7 * i + 3 * j + 5 * li) % 11 - 5) / d for j in range(b)] for i in range(a)])
        bias = np.array([((5 * j + li) % 7 - 3) / 16.0 for j in range(b)])
        out.append((w, bias))
    return out
