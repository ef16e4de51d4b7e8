"""Training of the autoencoder against a plain numpy loop, on own rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sismo.operators import net
from sismo.operators import ordering as od
from sismo.operators import train
from sismo.schema import AE_EPOCHS, AE_LAYERS

COLS = list("abcd")


def _rows(n=900, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) @ rng.normal(size=(2, 4)) + 0.05 * rng.normal(size=(n, 4))
    return pd.DataFrame(x, columns=COLS).assign(pos=np.arange(n), is_validation=(np.arange(n) >= n * 9 // 10).astype(int))


def _as64(params):
    return [(w.astype(np.float64), b.astype(np.float64)) for w, b in params]


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    layers = (3, 5, 2, 5, 3)
    vector = rng.normal(size=sum((a + 1) * b for a, b in zip(layers, layers[1:])))
    x, slope = rng.normal(size=(17, 3)), np.empty_like(vector)
    loss = train.loss_and_gradient(train._views(vector, layers), x, train._views(slope, layers))
    assert abs(loss - ((net.forward_np(train._views(vector, layers), x) - x) ** 2).mean()) < 1e-12
    for i in range(len(vector)):
        two = []
        for step in (1e-6, -1e-6):
            moved = vector.copy()
            moved[i] += step
            two.append(((net.forward_np(train._views(moved, layers), x) - x) ** 2).mean())
        assert abs((two[0] - two[1]) / 2e-6 - slope[i]) < 1e-6


def test_one_shard_is_plain_mini_batch_adam(spark):
    """Batch by batch in float64: loss before each step, the bias-corrected
    update, the held-out rows after each epoch."""
    pdf, layers, seed, epochs, batch = _rows(), (4, 6, 3, 6, 4), 5, 4, 64
    fit = train.fit_autoencoder(spark.createDataFrame(pdf).repartition(3), COLS, layers, epochs, batch, seed=seed)
    x = pdf.loc[pdf.is_validation == 0, COLS].to_numpy(np.float32).astype(np.float64)
    held = pdf.loc[pdf.is_validation == 1, COLS].to_numpy(np.float32).astype(np.float64)
    w = train.initial(layers, seed).astype(np.float64)
    m, v, t, g = np.zeros_like(w), np.zeros_like(w), 0, np.empty_like(w)
    want = []
    for epoch in range(1, epochs + 1):
        order, losses = np.random.default_rng([seed, epoch, 0]).permutation(len(x)), []
        for p in range(0, len(x), batch):
            part = x[order[p:p + batch]]
            losses.append((train.loss_and_gradient(train._views(w, layers), part, train._views(g, layers)), len(part)))
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.001 * (1 - 0.999 ** t) ** 0.5 / (1 - 0.9 ** t) * m / (np.sqrt(v) + 1e-7)
        want.append((epoch, np.average([a for a, _ in losses], weights=[b for _, b in losses]),
                     ((net.forward_np(train._views(w, layers), held) - held) ** 2).mean()))
    assert (fit.n_train, fit.n_validation) == (len(x), len(held)) == (810, 90)
    np.testing.assert_allclose(np.array(fit.history), np.array(want), rtol=1e-4)


@pytest.mark.parametrize("parts", [1, 5])
def test_shards_train_on_every_row_and_agree_whatever_the_layout(spark, parts):
    pdf = _rows()
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=parts)).repartition(parts)
    fit = train.fit_autoencoder(df, COLS, (4, 8, 3, 8, 4), epochs=12, batch=8, shard_rows=200)
    assert (fit.n_train, fit.n_validation) == (810, 90)
    assert fit.history[-1][1] < 0.5 * fit.history[0][1] and fit.history[-1][2] < 0.5 * fit.history[0][2]
    held = pdf.loc[pdf.is_validation == 1, COLS].to_numpy()
    assert abs(((net.forward_np(_as64(fit.params), held) - held) ** 2).mean() - fit.history[-1][2]) < 1e-5
    again = train.fit_autoencoder(spark.createDataFrame(pdf), COLS, (4, 8, 3, 8, 4), epochs=12, batch=8, shard_rows=200)
    assert again.history == fit.history


def test_states_are_averaged_by_rows():
    """Two shards of 1 and 3 rows, one of them in another task."""
    def summed(rows):
        return [r for b in train._weighed([train._batch(zip(*rows), train.SUMS)]) for r in b.to_pylist()]
    rows = [(0, 0, 1, 2.0, np.array([1.0, 8.0]).tobytes()), (0, 1, 3, 4.0, np.array([5.0, 0.0]).tobytes()), (1, 2, 7, 3.0, b"")]
    got = {r["is_validation"]: r for r in train._added(summed(rows[:1]) + summed(rows[1:]))}
    assert (got[0]["n"], got[0]["loss"], got[1]["n"], got[1]["loss"]) == (4, 6.0, 7, 3.0)
    assert (got[0]["state"] / got[0]["n"]).tolist() == [4.0, 2.0]


def test_no_training_or_held_out_rows(spark):
    df = spark.createDataFrame(_rows(40))
    none = train.fit_autoencoder(df.where("is_validation = 1"), COLS, epochs=2)
    assert (none.n_train, none.n_validation, none.history) == (0, 4, [])
    assert train.loss_history(spark, none).count() == 0
    alone = train.fit_autoencoder(df.where("is_validation = 0"), COLS, epochs=2)
    assert [r["key"] for r in train.loss_history(spark, alone).collect()] == ["Loss"] * 2
    nulls = df.withColumn("a", F.when(F.col("pos") % 3 == 0, None).otherwise(F.col("a")))
    assert train.fit_autoencoder(nulls, COLS, epochs=1).n_train == 24


def test_validation_tail_over_positions_with_gaps(spark):
    for n, most in ((0, 0), (1, 0), (25, 22)):
        df = spark.createDataFrame([(i * i + 3,) for i in range(n)], "pos long")
        got = sorted((r.pos, r.is_validation) for r in od.validation_tail(df, gaps=True).collect())
        assert got == [(i * i + 3, int(i >= most)) for i in range(n)]
    same = spark.createDataFrame([(7,)] * 20, "pos long")
    assert od.validation_tail(same, gaps=True).agg(F.sum("is_validation")).first()[0] == 2


def test_loss_history_holds_every_epoch_of_the_network(spark, monkeypatch):
    """A row per epoch and key of the trained 4-64-32-10-32-64-4 network, a
    tenth of the distinct rows held out (repeats leave gaps in the positions)."""
    from sismo.plans import q_learn
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(200, 4)) * [1, 30, 5, 8] + [4, 60, -3, 118], 2, axis=0).tolist()
    rows = spark.createDataFrame([(i, 2010 + i % 3, *v) for i, v in enumerate(x)],
                                 "pos long, year int, magnitude double, depth double, latitude double, longitude double")
    monkeypatch.setattr(q_learn, "interp", lambda spark, sf: rows)
    fits, fit = [], train.fit_autoencoder
    monkeypatch.setattr(train, "fit_autoencoder", lambda *a, **k: fits.append(fit(*a, **k)) or fits[-1])
    got = q_learn.q_loss_history(spark, "").toPandas()
    assert [w.shape for w, _ in fits[0].params] == list(zip(AE_LAYERS, AE_LAYERS[1:]))
    assert sorted(zip(got["key"], got["epoch"])) == [(k, e) for k in ("Loss", "Val Loss") for e in range(1, AE_EPOCHS + 1)]
    assert set(got["n_train"]) == {180} and set(got["n_validation"]) == {20}
    for _, g in got.sort_values("epoch").groupby("key"):
        assert np.isfinite(g["value"]).all() and g["value"].iloc[-1] < 0.9 * g["value"].iloc[0]
