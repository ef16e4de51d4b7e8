"""Language identification by averaged hashed subword embeddings (operator 8).

A text's subwords are all byte n-grams of 2 to 4 bytes of its lower-cased
letters (other characters become spaces) hashed into ``BUCKETS``. Their
embeddings are averaged and a linear softmax names the language; both are
trained by stochastic gradient descent in numpy on at most ``PER_LANG``
labelled texts a language: those of the smallest id hashes among all labelled
rows that are not held out, however large the table. Of a text longer than
``TRAIN_CHARS`` a window of that length is used, its place picked by id hash;
an id that is repeated with a label gives one text. A part of the sample is kept back to
calibrate: a temperature for the scores, and the lowest score at which the
accepted answers are right at rate ``ACCEPT``. Rows below it are ``rejected``.

Prediction multiplies embeddings and softmax weights into one table, so a
text costs a gather and a sum per n-gram: map-only, whole texts, Arrow. For
the sample, the ids and labels are shuffled once and cut to ``PER_LANG`` a
language, first in ``PARTS`` parts of them, then of these together; the ids
left are broadcast to fetch their texts.

Defined results: null texts and texts without a letter are ``und`` with score
0 and rejected; without any labelled text all rows are ``und``; repeated rows
each get their own equal row; an empty table gives an empty result; lang,
source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textarr as ta

ORDERS = (2, 3, 4)
BITS = 15
BUCKETS = 1 << BITS
WIDTH = 16
PER_LANG = 800
TRAIN_CHARS = 20_000
PARTS = 64
EPOCHS = 6
RATE = 0.3
BATCH = 16
ACCEPT = 0.98
FOLDS = 5

SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"

_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
_PLAIN[0x80:] = np.arange(0x80, 0x100)
_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def lowered(column):
    if column.null_count:
        column = column.fill_null("")
    return ta.utf8(pc.utf8_lower(column.cast(pa.large_string())))


def grams(buf: np.ndarray, off: np.ndarray):
    """(bucket, mask) for each order: the n-gram at every byte position, and
    whether it lies in one document and is not all space."""
    b = _PLAIN[buf].astype(np.uint32)
    n = len(b)
    doc_end = np.repeat(off[1:], np.diff(off))
    acc = np.zeros(n, np.uint32)
    letters = np.zeros(n, bool)
    for k in range(max(ORDERS)):
        m = n - k
        if m <= 0:
            return
        acc = acc[:m] + b[k:] * _MUL[k]
        letters = letters[:m] | (b[k:] != 0x20)
        if k + 1 in ORDERS:
            h = (acc ^ (acc >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
            yield (h >> np.uint32(32 - BITS)), letters & (np.arange(m) + k < doc_end[:m])


def bags(texts: list[str]):
    """Distinct buckets of each text and their shares."""
    buf, off = lowered(pa.array(texts, pa.large_string()))
    out = []
    for a, b in zip(off[:-1], off[1:]):
        total = np.zeros(BUCKETS)
        for bucket, ok in grams(buf[a:b], np.array([0, b - a])):
            total += np.bincount(bucket[ok], minlength=BUCKETS)
        at = np.flatnonzero(total)
        out.append((at, total[at] / max(1.0, total.sum())))
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    heat: float        # scores are softmax(logits / heat)
    least: float       # scores below are rejected


def _softmax(s):
    s = np.exp(s - s.max(axis=-1, keepdims=True))
    return s / s.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model | None:
    """Fit on four fifths of the texts, calibrate on the rest (all of them
    when there are fewer than 50)."""
    names = sorted(set(langs))
    if not names:
        return None
    y = np.array([names.index(x) for x in langs])
    bag = bags(texts)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    soft, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    order = rng.permutation(len(y))
    kept = order[::5] if len(y) >= 50 else order
    fit = np.setdiff1d(order, kept) if len(y) >= 50 else order
    steps = EPOCHS * -(-len(fit) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(fit)
        for i in range(0, len(mixed), BATCH):
            rows = mixed[i:i + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            at = np.concatenate([bag[r][0] for r in rows])
            share = np.concatenate([bag[r][1] for r in rows])
            who = np.repeat(np.arange(len(rows)), [len(bag[r][0]) for r in rows])
            hidden = np.zeros((len(rows), WIDTH))
            np.add.at(hidden, who, emb[at] * share[:, None])
            err = _softmax(hidden @ soft + bias)
            err[np.arange(len(rows)), y[rows]] -= 1
            back = err @ soft.T
            soft -= rate * hidden.T @ err
            bias -= rate * err.mean(axis=0)
            # a text's gradient is spread over its subwords; scaled up, as shares are small
            np.subtract.at(emb, at, rate * WIDTH * share[:, None] * back[who] * 8)
    table = emb @ soft
    logits = np.array([bag[r][1] @ table[bag[r][0]] + bias for r in kept]).reshape(len(kept), len(names))
    target = y[kept]
    heats = np.geomspace(0.05, 20, 60)
    # smoothed targets: even a sample without a mistake proves no certainty
    off = 1 / (len(kept) + 2)
    goal = np.full(logits.shape, off / max(1, len(names) - 1))
    goal[np.arange(len(kept)), target] = 1 - off
    loss = [-(goal * np.log(_softmax(logits / t) + 1e-12)).sum(axis=1).mean() for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = _softmax(logits / heat)
    best, right = p.max(axis=1), p.argmax(axis=1) == target
    rank = np.argsort(-best, kind="stable")
    rate = np.cumsum(right[rank]) / np.arange(1, len(rank) + 1)
    enough = np.flatnonzero(rate >= ACCEPT)
    least = float(best[rank[enough[-1]]]) if len(enough) else 1.0
    return Model(names, table, bias, heat, least)


def predict(model: Model, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language number, score) of every document of a slice."""
    table = np.ascontiguousarray(model.table.T.astype(np.float32))
    n = len(off) - 1
    total, count = np.zeros((n, len(model.langs))), np.zeros(n)
    for bucket, ok in grams(buf, off):
        at = np.minimum(off, len(bucket))
        count += ta.counts(ok, at)
        for c in range(len(model.langs)):
            run = np.zeros(len(bucket) + 1)
            np.cumsum(np.where(ok, table[c][bucket], 0), dtype=np.float64, out=run[1:])
            total[:, c] += np.diff(run[at])
    logits = total / np.maximum(count, 1)[:, None] + model.bias
    p = _softmax(logits / model.heat)
    return p.argmax(axis=1), p.max(axis=1)


def _labels(model):
    def run(batches):
        for batch in batches:
            buf_all, off_all = lowered(batch.column(1))
            n = len(batch)
            lang, score = ["und"] * n, np.zeros(n)
            for a, b in ta.slices(off_all):
                off = off_all[a:b + 1] - off_all[a]
                buf = buf_all[off_all[a]:off_all[b]]
                best, p = predict(model, buf, off)
                ascii_letters = ta.counts((_PLAIN[buf] != 0x20) & (buf < 0x80), off) > 0
                high = ta.counts(buf >= 0x80, off) > 0
                for i in range(b - a):
                    if ascii_letters[i] or high[i] and any(c.isalpha() for c in buf[off[i]:off[i + 1]].tobytes().decode()):
                        lang[a + i], score[a + i] = model.langs[best[i]], p[i]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lang), pa.array(score),
                                              pa.array(score < model.least)], names=["doc_id", "lang_pred", "score", "rejected"])
    return run


def held_out(doc_id="doc_id"):
    """Rows whose id checksum divides evenly into the folds."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def _smallest(ids: DataFrame, *by: str) -> DataFrame:
    order = W.partitionBy(*by).orderBy("hash", "doc_id")
    return ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= PER_LANG).drop("n")


def fit(docs: DataFrame) -> Model | None:
    """Train on the bounded sample described in the module text."""
    pool = docs.select("doc_id", "lang", "text").where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    ids = (pool.select("doc_id", "lang").distinct()
           .select("doc_id", "lang", F.xxhash64("doc_id").alias("hash"), F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")))
    picked = _smallest(_smallest(ids, "lang", "part"), "lang").select("doc_id", "lang")
    window = F.expr(f"substring(text, 1 + cast(pmod(xxhash64(doc_id), greatest(length(text) - {TRAIN_CHARS}, 0) + 1) as int), {TRAIN_CHARS})")
    texts = pool.join(F.broadcast(picked), ["doc_id", "lang"]).select("doc_id", "lang", window.alias("text"))
    rows = sorted(texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect())
    return train([r.text for r in rows], [r.lang for r in rows])


def identify_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score,
    rejected. ``model`` defaults to ``fit(docs)``."""
    model = fit(docs) if model is None else model
    if model is None:
        out = docs.select(F.col("doc_id").cast("long"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    else:
        out = docs.select("doc_id", "text").mapInArrow(_labels(model), SCHEMA)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
