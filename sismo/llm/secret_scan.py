"""Secrets by a character convolutional network (operator 11).

Patterns find the base spans (assign, access, hex). A small network then reads
every other candidate with the characters around it and adds spans that
patterns miss, such as an upper-case key or one without its keyword.

* Candidates: runs of key characters of 8 or more that hold a digit, mix
  cases, or reach 20 characters. Long runs are read whole.
* Network (numpy): two convolutions over bytes (widths 5 and 3), pooled apart
  over what stands before, in and after the candidate, softmax over "none" and
  the kinds. It runs over blocks of bytes, so one long run needs no more memory.
* Training: labelled findings of the corpus itself, i.e. base spans with their
  kind, and candidates that touch none: all of all rows, whole (copies count
  once; values too long for a batch go through it in stretches). Findings also train with their cases swapped, without and with foreign context;
  unmarked candidates that a network of the other half calls findings do not.
* Two parts in three fit the weights. The rest, in the same versions, sets the
  softmax temperature and, for each kind, the highest threshold that still
  finds ``RECALL`` of them, never under ``LEAST``. A kind without findings is never predicted.
* Up to ``SHARD`` windows (of ``UNIT`` bytes; longer ones count as several) train in one task. More are dealt by their hashes into
  shards of about that many, a task each: in each of ``EPOCHS`` rounds a shard
  goes through all its windows from the common weights, then weights and moments
  are averaged by examples. Temperature and thresholds come from all held
  windows, by sums and counts, as in one task.

Two map passes over the table; the windows found stay in tasks, the driver
gets counts and sums of weights.

Defined results: null text counts as empty; every row gets its own row;
without findings (an empty table too) nothing is added; other columns are
ignored; spans are in code points.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textarr as ta

KINDS = ("assign", "access", "hex")
NONE = len(KINDS)
SHARD = 4096  # windows, by units, that one task trains on
UNIT = 256
PARTS = 6
BEFORE, AFTER = 32, 16
RECALL, LEAST = 0.95, 0.5
SURELY_NONE = 0.8  # the other half's belief that an unmarked candidate needs to train as none
LONG = 20
EPOCHS, LEAST_STEPS, BATCH, RATE = 4, 250, 64, 3e-3
HEATS = np.geomspace(0.5, 8, 25)
WIDE, NARROW = 5, 3
F1, F2 = 16, 32
BLOCK = 1 << 15
GAP = 3  # bytes of padding that keep windows apart: half of both convolutions

# The patterns of the base spans, on UTF-8 bytes (ASCII classes).
ASSIGN = re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
OWN_LOOK = re.compile(rb"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")  # of assigned values that are findings of another kind, too

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


_DIGIT = _mask(b"0123456789")
_LOWER = _mask(bytes(range(0x61, 0x7B)))
_UPPER = _mask(bytes(range(0x41, 0x5B)))
_KEY = _DIGIT | _LOWER | _UPPER | _mask(b"+/_=.-")
_EDGE = _mask(b".-=")
_HEX = _DIGIT | _mask(b"abcdef")
#: Byte classes of the network: 0 padding, ASCII by itself, all others alike.
_CHAR = np.minimum(np.arange(256), 128).astype(np.uint8) + 1
CHARS = 130


# ---- spans --------------------------------------------------------------

def _runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true entries that cross no document border."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1] & ~edge[1:n]
    after[:-1] = inside[1:] & ~edge[1:n]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes of one document, by start and kind."""
    low = text.lower()
    out = []
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    buf = np.frombuffer(text, np.uint8)
    s, e = _runs(_HEX[buf], np.array([0, len(buf)]))
    out += [(int(a), 2, int(b)) for a, b in zip(s, e) if b - a >= LEAST_HEX]
    return sorted(out)


def _sum(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[end] - run[start]


def candidates(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end (bytes) of every candidate."""
    s, e = _runs(_KEY[buf], off)
    core = ~_EDGE[buf]
    at = np.arange(len(buf))
    if len(buf):  # stops and the like at either end belong to the sentence
        last = np.maximum.accumulate(np.where(core, at, -1))
        first = np.minimum.accumulate(np.where(core, at, len(buf))[::-1])[::-1]
        s, e = np.minimum(first[s], e), np.maximum(last[e - 1] + 1, s)
    e = np.maximum(s, e)
    size = e - s
    digits, upper, lower = (_sum(m[buf], s, e) for m in (_DIGIT, _UPPER, _LOWER))
    mixed = (upper > 1) & (lower > 1)
    ok = (size >= 8) & ((digits > 0) | mixed | (size >= LONG))
    s, e = s[ok], e[ok]
    return np.searchsorted(off, s, side="right") - 1, s, e


@dataclass
class Found:
    """Base spans and candidates of one document, in bytes of the slice."""
    doc: int
    base: list[tuple[int, int, int]]
    start: np.ndarray
    end: np.ndarray


def findings(buf: np.ndarray, off: np.ndarray):
    """``Found`` of every document of a slice that has either."""
    doc, s, e = candidates(buf, off)
    first = np.searchsorted(doc, np.arange(len(off)))
    hs, he = _runs(_HEX[buf], off)
    has = np.zeros(len(off) - 1, bool)
    has[np.searchsorted(off, hs[he - hs >= LEAST_HEX], side="right") - 1] = True
    raw = buf.tobytes()
    low = raw.lower()
    for word, where in (*((k, low) for k in KEYWORDS), (b"AKIA", raw)):
        at = where.find(word)
        while at >= 0:  # once a document is known to hold one, go on behind it
            d = int(np.searchsorted(off, at, side="right")) - 1
            has[d] = True
            at = where.find(word, int(off[d + 1]))
    for d in np.flatnonzero(has | (np.diff(first) > 0)):
        o = int(off[d])
        base = [(a + o, k, b + o) for a, k, b in base_spans(raw[o:int(off[d + 1])])] if has[d] else []
        yield Found(int(d), base, s[first[d]:first[d + 1]], e[first[d]:first[d + 1]])


def apart(f: Found) -> np.ndarray:
    """Candidates that touch no base span."""
    if not f.base:
        return np.ones(len(f.start), bool)
    a = np.array([x[0] for x in f.base])
    b = np.maximum.accumulate([x[2] for x in f.base])
    k = np.searchsorted(a, f.end) - 1  # the last base span that begins before the candidate's end
    return (k < 0) | (b[np.maximum(k, 0)] <= f.start)


# ---- network ------------------------------------------------------------

@dataclass
class Net:
    """Weights and, per kind, the threshold (over 1: never)."""
    t1: np.ndarray  # WIDE x CHARS x F1
    b1: np.ndarray
    w2: np.ndarray  # NARROW * F1 x F2
    b2: np.ndarray
    w3: np.ndarray  # 4 * F2 + 1 x KINDS + 1
    b3: np.ndarray
    heat: float = 1.0
    least: tuple = (2.0,) * len(KINDS)

    def weights(self):
        return [self.t1, self.b1, self.w2, self.b2, self.w3, self.b3]


def fresh(rng) -> Net:
    def w(*shape, fan):
        return rng.normal(0, np.sqrt(2 / fan), shape).astype(np.float32)
    return Net(w(WIDE, CHARS, F1, fan=WIDE), np.zeros(F1, np.float32), w(NARROW * F1, F2, fan=NARROW * F1), np.zeros(F2, np.float32),
               w(4 * F2 + 1, NONE + 1, fan=4 * F2), np.zeros(NONE + 1, np.float32))


def _conv(net: Net, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both layers along the last axis of x (byte classes, GAP of padding at
    either end): first layer, its neighbours side by side, second layer."""
    h = sum(net.t1[k][x[..., k:x.shape[-1] - WIDE + 1 + k]] for k in range(WIDE)) + net.b1
    h = np.maximum(h, 0)
    n = h.shape[-2]
    side = np.concatenate([h[..., k:n - NARROW + 1 + k, :] for k in range(NARROW)], axis=-1)
    return h, side, np.maximum(side @ net.w2 + net.b2, 0)


def _softmax(s):
    s = np.exp(s - s.max(axis=1, keepdims=True))
    return s / s.sum(axis=1, keepdims=True)


def scores(net: Net, buf: np.ndarray, off: np.ndarray, doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Logits of candidates s:e of a slice, whole and with their context."""
    if not len(s):
        return np.zeros((0, NONE + 1))
    lo, hi = np.maximum(s - BEFORE, off[doc]), np.minimum(e + AFTER, off[doc + 1])
    size = hi - lo + GAP
    end = np.cumsum(size)
    total = int(end[-1])
    best = np.zeros((len(s), 3, F2), np.float32)  # what is pooled is never negative
    mean = np.zeros((len(s), F2))
    for p in range(0, total, BLOCK):
        # positions p - GAP : q + GAP; a window is its bytes and GAP bytes of padding
        q = min(p + BLOCK, total)
        at = np.arange(p - GAP, q + GAP)
        w = np.minimum(np.searchsorted(end, at, side="right"), len(s) - 1)
        byte = lo[w] + at - (end[w] - size[w])
        real = (at >= 0) & (byte < hi[w])
        x = np.where(real, _CHAR[buf[np.clip(byte, 0, len(buf) - 1)]], 0)
        h = _conv(net, x)[2]
        w, byte, real = w[GAP:-GAP], byte[GAP:-GAP], real[GAP:-GAP]
        part = np.where(byte < s[w], 0, np.where(byte < e[w], 1, 2))
        key = (w * 3 + part)[real]
        h = h[real]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        if len(first):
            k = key[first]
            best[k // 3, k % 3] = np.maximum(best[k // 3, k % 3], np.maximum.reduceat(h, first))
            inner = k % 3 == 1
            mean[k[inner] // 3] += np.add.reduceat(h, first, dtype=np.float64)[inner]
    return _head(net, best, mean / (e - s)[:, None], e - s)


def _head(net, best, mean, size):
    x = np.concatenate([best.reshape(len(best), -1), mean, np.log(size / 16)[:, None]], axis=1)
    return x.astype(np.float32) @ net.w3 + net.b3


# ---- training -----------------------------------------------------------

Example = tuple[bytes, bytes, bytes]  # before, candidate, after


def _dense(rows: list[Example]):
    """Byte classes (padded) and part of each position: -1 padding."""
    size = max(sum(map(len, r)) for r in rows)
    x = np.zeros((len(rows), size + 2 * GAP), np.uint8)
    part = np.full((len(rows), size), -1, np.int8)
    for i, r in enumerate(rows):
        b = b"".join(r)
        x[i, GAP:GAP + len(b)] = _CHAR[np.frombuffer(b, np.uint8)]
        part[i, :len(b)] = np.repeat([0, 1, 2], [len(z) for z in r])
    return x, part


def _stretches(part: np.ndarray) -> list[tuple[int, int]]:
    """Positions in stretches of about ``BLOCK`` over all rows."""
    n, size = part.shape
    step = max(1, BLOCK // n)
    return [(p, min(p + step, size)) for p in range(0, size, step)]


def _forward(net: Net, rows: list[Example]):
    x, part = _dense(rows)
    best = np.zeros((3, len(rows), F2))
    where = np.zeros((3, len(rows), F2), np.int64)
    mean = np.zeros((len(rows), F2))
    stretches = _stretches(part)
    for p, q in stretches:
        conv = _conv(net, x[:, p:q + 2 * GAP])
        for k in range(3):
            h = np.where((part[:, p:q] == k)[..., None], conv[2], 0)
            at = h.argmax(axis=1)
            top = np.take_along_axis(h, at[:, None], axis=1)[:, 0]
            where[k] = np.where(top > best[k], at + p, where[k])
            best[k] = np.maximum(top, best[k])
        mean += np.where((part[:, p:q] == 1)[..., None], conv[2], 0).sum(axis=1)
    size = np.array([len(r[1]) for r in rows])
    feat = np.concatenate([*best, mean / size[:, None], np.log(size / 16)[:, None]], axis=1).astype(np.float32)
    return feat @ net.w3 + net.b3, (x, part, conv if len(stretches) == 1 else None, where, size, feat)


def _gradients(net: Net, cache, err: np.ndarray) -> list[np.ndarray]:
    x, part, whole, where, size, feat = cache
    back = err @ net.w3.T
    gt, gb, gw2, gb2 = (np.zeros_like(a) for a in net.weights()[:4])
    for p, q in _stretches(part):
        h1, side, h2 = whole or _conv(net, x[:, p:q + 2 * GAP])
        here = part[:, p:q]
        g2 = np.zeros_like(h2)
        for k in range(3):
            r, c = np.nonzero((where[k] >= p) & (where[k] < q))
            at = where[k][r, c] - p
            np.add.at(g2, (r, at, c), np.where(h2[r, at, c] * (here[r, at] == k) > 0, back[r, k * F2 + c], 0))
        g2 += (here == 1)[..., None] * (back[:, None, 3 * F2:4 * F2] / size[:, None, None])
        g2 *= h2 > 0
        flat = g2.reshape(-1, F2)
        gs = (flat @ net.w2.T).reshape(*side.shape)
        g1 = np.zeros_like(h1)
        n = h1.shape[1]
        for k in range(NARROW):
            g1[:, k:n - NARROW + 1 + k] += gs[..., k * F1:(k + 1) * F1]
        g1 *= h1 > 0
        for k in range(WIDE):
            one = np.eye(CHARS, dtype=np.float32)[x[:, p + k:p + k + n].ravel()]
            gt[k] += one.T @ g1.reshape(-1, F1)
        gb += g1.sum((0, 1))
        gw2 += side.reshape(-1, NARROW * F1).T @ flat
        gb2 += flat.sum(0)
    return [gt, gb, gw2, gb2, feat.T @ err, err.sum(0)]


def _batches(rows: list, example) -> list[list]:
    """Up to ``BATCH`` in a row together; long ones in smaller batches."""
    out, most = [], 0
    for r in rows:
        size = sum(map(len, example(r)))
        if not out or len(out[-1]) == BATCH or max(most, size) * (len(out[-1]) + 1) > 2 * BLOCK:
            out.append([])
            most = 0
        out[-1].append(r)
        most = max(most, size)
    return out


def _swapped(r: Example) -> Example:
    return r[0], r[1].swapcase(), r[2]


@dataclass
class Adam:
    """A network in training: the moments of its gradients, steps so far."""
    net: Net
    m: list[np.ndarray]
    v: list[np.ndarray]
    step: int = 0

    @classmethod
    def of(cls, net: Net) -> Adam:
        return cls(net, *([np.zeros_like(a) for a in net.weights()] for _ in range(2)))

    def vector(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (*self.net.weights(), *self.m, *self.v)] + [[self.step]])

    def put(self, vector: np.ndarray) -> None:
        at = 0
        for a in (*self.net.weights(), *self.m, *self.v):
            a[...] = vector[at:at + a.size].reshape(a.shape)
            at += a.size
        self.step = int(round(vector[-1]))

    def train(self, examples, weight, epochs: int, rng) -> None:
        """Passes over (example, label) pairs; ``weight`` by label."""
        w = self.net.weights()
        examples = sorted(examples, key=lambda z: sum(map(len, z[0])))  # batches of like sizes
        batches = _batches(examples, lambda z: z[0])
        for _ in range(epochs):
            for i in rng.permutation(len(batches)):
                self.step += 1
                y = np.array([b[1] for b in batches[i]])
                logit, cache = _forward(self.net, [b[0] for b in batches[i]])
                err = (_softmax(logit) - np.eye(NONE + 1)[y]) * weight[y][:, None] / len(y)
                for j, g in enumerate(_gradients(self.net, cache, err.astype(np.float32))):
                    self.m[j] = 0.9 * self.m[j] + 0.1 * g
                    self.v[j] = 0.999 * self.v[j] + 0.001 * g * g
                    w[j] -= (RATE * (self.m[j] / (1 - 0.9 ** self.step)) / (np.sqrt(self.v[j] / (1 - 0.999 ** self.step)) + 1e-8)).astype(w[j].dtype)


def _weights(count: np.ndarray) -> np.ndarray:
    """Weights that make kinds count alike, from their numbers of examples."""
    return np.where(count > 0, count.sum() / (np.maximum(count, 1) * max(1, (count > 0).sum())), 0).clip(0, 5)


def _units(value: bytes) -> int:
    """How many windows of common size a value is worth in work."""
    return -(-len(value) // UNIT)


def _epochs(units: int) -> int:
    return max(EPOCHS, -(-LEAST_STEPS // max(1, -(-units // BATCH))))


def _fitted(examples, rng) -> Net:
    """Weights by Adam on (example, label) pairs, kinds weighted alike."""
    state = Adam.of(fresh(rng))
    weight = _weights(np.bincount([y for _, y in examples], minlength=NONE + 1))
    state.train(examples, weight, _epochs(sum(_units(r[1]) for r, _ in examples)), rng)
    return state.net


def _versions(rows, labels, rng):
    """Training versions of each example: findings with their cases swapped,
    without context and in a foreign one; others as they are and bare."""
    others = [r for r, y in zip(rows, labels) if y == NONE] or [(b"", b"", b"")]
    out = []
    for r, y in zip(rows, labels):
        out.append((r, y))
        if y == 0 and OWN_LOOK.fullmatch(r[1]):
            continue
        out.append(((b"", r[1], b""), y))
        if y != NONE:
            o = others[int(rng.integers(len(others)))]
            out += [(_swapped(r), y), ((o[0], r[1], o[2]), y)]
    return out


def _n_versions(y: int, value: bytes) -> int:
    return 2 if y == NONE else 1 if y == 0 and OWN_LOOK.fullmatch(value) else 4


def _part(value: bytes) -> int:
    """Equal values stay in one of the parts."""
    return xxhash.xxh64_intdigest(value) % PARTS


def _logits(net: Net, rows: list[Example]) -> np.ndarray:
    return np.concatenate([_forward(net, b)[0] for b in _batches(rows, lambda r: r)])


def train(rows: list[Example], labels: list[int], seed: int = 0) -> Net | None:
    """Network from labelled examples; None without any finding. A candidate
    that no pattern marks may be a secret all the same: one that a network
    fitted on the other half calls a finding is left out of the "none"s."""
    if not any(y != NONE for y in labels):
        return None
    rng = np.random.default_rng(seed)
    part = np.array([_part(r[1]) for r in rows])
    label = np.array(labels)
    kept = np.ones(len(rows), bool)
    for half in (0, 1):
        mine, rest = np.flatnonzero(part % 2 != half), np.flatnonzero((part % 2 == half) & (label == NONE))
        if (label[mine] != NONE).any() and len(rest):
            net = _fitted(_versions([rows[i] for i in mine], label[mine].tolist(), rng), rng)
            kept[rest] = _softmax(_logits(net, [rows[i] for i in rest]))[:, NONE] >= SURELY_NONE
    fit, check = np.flatnonzero(kept & (part >= 2)), np.flatnonzero(kept & (part < 2))
    if not (label[fit] != NONE).any():
        fit = np.flatnonzero(kept)
    net = _fitted(_versions([rows[i] for i in fit], label[fit].tolist(), rng), rng)
    check = check if len(check) else fit
    return _calibrated(net, _versions([rows[i] for i in check], label[check].tolist(), rng))


def _losses(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed loss at each of ``HEATS``."""
    return np.array([-np.log(_softmax(logit / h)[np.arange(len(y)), y] + 1e-12).sum() for h in HEATS])


def _belief(logit: np.ndarray, heat: float) -> np.ndarray:
    """That a candidate is any finding."""
    return 1 - _softmax(logit / heat)[:, NONE]


def _missed(n: int) -> int:
    """How many of n held findings the threshold may lose."""
    return int(np.floor((1 - RECALL) * n))


def _calibrated(net: Net, check) -> Net:
    """Temperature by likelihood and thresholds by recall on held findings."""
    y = np.array([c[1] for c in check])
    logit = _logits(net, [c[0] for c in check])
    net.heat = float(HEATS[int(np.argmin(_losses(logit, y)))])
    p = _belief(logit, net.heat)
    least = []
    for k in range(NONE):
        mine = np.sort(p[y == k])
        # the highest threshold that keeps RECALL of the held findings
        least.append(max(LEAST, float(mine[_missed(len(mine))])) if len(mine) else 2.0)
    net.least = tuple(least)
    return net


# ---- training over tasks ------------------------------------------------

WINDOWS = "label int, h long, part int, units int, versions int, before binary, value binary, after binary"


def _batch(columns, schema: str) -> pa.RecordBatch:
    """Columns of Python values as the batch that a Spark schema describes."""
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(columns, kinds)], names=list(names))


def _labelled(batches):
    """Every base span and every candidate apart from them, as windows; those
    of a slice once each."""
    for batch in batches:
        buf_all, off_all = ta.utf8(batch.column(0))
        for p, q in ta.slices(off_all):
            buf, off = buf_all[off_all[p]:off_all[q]], off_all[p:q + 1] - off_all[p]
            raw = buf.tobytes()
            seen = {}  # keys in order of appearance
            for f in findings(buf, off):
                lo, hi = int(off[f.doc]), int(off[f.doc + 1])
                for a, k, b in f.base:
                    if k == 0:  # the network reads the value, its keyword is context
                        a = b - len(ASSIGN.match(raw[a:b])[2])
                    seen[k, raw[max(lo, a - BEFORE):a], raw[a:b], raw[b:min(hi, b + AFTER)]] = None
                ok = apart(f)
                for a, b in zip(f.start[ok].tolist(), f.end[ok].tolist()):
                    seen[NONE, raw[max(lo, a - BEFORE):a], raw[a:b], raw[b:min(hi, b + AFTER)]] = None
            rows = [(y, xxhash.xxh64_intdigest(b"\0".join(r)) >> 1, _part(r[1]), _units(r[1]), _n_versions(y, r[1]), *r) for y, *r in sorted(seen, key=lambda w: w[0])]
            yield _batch(zip(*rows) if rows else [()] * 8, WINDOWS)


def _dealt(windows: DataFrame, n: int, group=None, groups: int = 1) -> DataFrame:
    """Windows of ``n`` units (of a group, at most) in one task a shard, dealt by their hashes."""
    k = max(1, -(-n // SHARD))
    group = F.lit(0) if group is None else group
    return windows.withColumn("shard", (group * k + F.col("h") % k).cast("int")).repartitionById(groups * k, "shard")


def _shards(batches):
    """Shard, examples and labels, in their order, of each shard of a task."""
    rows = sorted((r["shard"], r["label"], r["h"], r["value"], r["before"], r["after"]) for b in batches for r in b.to_pylist())
    for shard, mine in groupby(rows, key=lambda r: r[0]):
        mine = list(mine)
        yield shard, [(r[4], r[3], r[5]) for r in mine], [r[1] for r in mine]


def _at_once(batches):
    """The network of a shard that holds all windows."""
    for _, rows, labels in _shards(batches):
        yield _batch([[pickle.dumps(train(rows, labels))]], "net binary")


STATES = "grp int, shard int, n long, state binary"


def _summed(batches):
    """Sum of the states of a task's shards, by group, weighted by their examples."""
    rows = sorted((r["grp"], r["shard"], r["n"], r["state"]) for b in batches for r in b.to_pylist())
    for g, mine in groupby(rows, key=lambda r: r[0]):
        mine = list(mine)
        yield _batch([[g], [mine[0][1]], [sum(r[2] for r in mine)], [sum(r[2] * np.frombuffer(r[3]) for r in mine).tobytes()]], STATES)


def _nets(windows: DataFrame, group, sizes: list[Size], seed: int) -> list[Net]:
    """A network for each group of the windows, all trained in the same rounds."""
    n, versions = [z.units.sum() for z in sizes], [z.versions.sum(axis=0) for z in sizes]
    states = [Adam.of(fresh(np.random.default_rng([seed, g]))) for g in range(len(n))]
    weight = [_weights(v) for v in versions]
    shards = max(1, -(-int(max(n)) // SHARD))
    dealt = _dealt(windows, int(max(n)), group, len(n))

    def one_round(turn, sent):
        def run(batches):
            for shard, rows, labels in _shards(batches):
                g = shard // shards
                rng = np.random.default_rng([seed, shard, turn])
                state = Adam.of(fresh(rng))
                state.put(sent[g])
                examples = _versions(rows, labels, rng)
                state.train(examples, weight[g], passes, rng)
                yield _batch([[g], [shard], [len(examples)], [state.vector().tobytes()]], STATES)
        return run

    tasks = int(np.ceil(np.sqrt(shards * len(n))))  # that sum up: about as many as each then has states
    passes = -(-max(_epochs(-(-int(z.work.sum()) // shards)) for z in sizes) // EPOCHS)  # of a shard in a round
    for turn in range(EPOCHS):
        sums = (dealt.mapInArrow(one_round(turn, [s.vector() for s in states]), STATES)
                .repartitionById(tasks, F.col("shard") % tasks).mapInArrow(_summed, STATES).collect())
        for g, state in enumerate(states):
            mine = sorted((r.shard, r.n, bytes(r.state)) for r in sums if r.grp == g)
            if mine:
                state.put(sum(np.frombuffer(v) for _, _, v in mine) / sum(k for _, k, _ in mine))
    return [s.net for s in states]


def _sure(windows: DataFrame, n: int, nets: list[Net | None]) -> DataFrame:
    """Without the unmarked candidates that the other half's network calls findings."""
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            keep = np.ones(len(rows), bool)
            for half, net in enumerate(nets):
                mine = [i for i, r in enumerate(rows) if r["label"] == NONE and r["part"] % 2 == half]
                mine.sort(key=lambda i: len(rows[i]["value"]))
                if net is not None and mine:
                    logit = _logits(net, [(rows[i]["before"], rows[i]["value"], rows[i]["after"]) for i in mine])
                    keep[mine] = _softmax(logit)[:, NONE] >= SURELY_NONE
            yield batch.filter(pa.array(keep))
    return _dealt(windows, n).drop("shard").mapInArrow(run, WINDOWS)


@dataclass
class Size:
    """Sums over windows by part and label: units, versions, units of all versions."""
    units: np.ndarray
    versions: np.ndarray
    work: np.ndarray

    def __getitem__(self, parts) -> Size:
        return Size(self.units[parts], self.versions[parts], self.work[parts])

    def findings(self) -> bool:
        return bool(self.units[:, :NONE].any())


def _size(windows: DataFrame) -> Size:
    out = Size(*np.zeros((3, PARTS, NONE + 1), np.int64))
    sums = [F.sum(c).alias(a) for c, a in (("units", "u"), ("versions", "v"), (F.col("units").cast("long") * F.col("versions"), "w"))]
    for r in windows.groupBy("part", "label").agg(*sums).collect():
        out.units[r.part, r.label], out.versions[r.part, r.label], out.work[r.part, r.label] = r.u, r.v, r.w
    return out


def _over_tasks(s, windows: DataFrame, size: Size, seed: int = 0) -> Net:
    """What ``train`` does, for windows of any number."""
    part = np.arange(PARTS)
    mine = [size[part % 2 != half] for half in (0, 1)]
    nets = [net if z.findings() else None for net, z in zip(_nets(windows, 1 - F.col("part") % 2, mine, seed), mine)]
    kept = s.keep(_sure(windows, int(size.units.sum()), nets), "sure")
    size = _size(kept)
    fit = part >= 2 if size[part >= 2].findings() else part >= 0
    check = part < 2 if size[part < 2].units.any() else fit
    of = [kept.where(F.col("part").isin(part[p].tolist())) for p in (fit, check)]
    net = _nets(of[0], None, [size[fit]], seed + 1)[0]
    _calibrated_over_tasks(s, net, of[1], size[check], seed)
    s.drop(kept)
    return net


LOGITS = "label int, " + ", ".join(f"l{i} double" for i in range(NONE + 1))


def _calibrated_over_tasks(s, net: Net, check: DataFrame, size: Size, seed: int) -> None:
    """What ``_calibrated`` does, for windows of any number."""
    def read(batch):
        c = [x.to_numpy() for x in batch.columns]
        return c[0], np.stack(c[1:], axis=1).astype(np.float32)

    def logits(batches):
        for shard, rows, labels in _shards(batches):
            examples = sorted(_versions(rows, labels, np.random.default_rng([seed, shard])), key=lambda z: sum(map(len, z[0])))
            logit = _logits(net, [r for r, _ in examples])
            yield _batch([[y for _, y in examples], *logit.astype(np.float64).T], LOGITS)

    def losses(batches):
        for y, logit in map(read, batches):
            yield _batch([range(len(HEATS)), _losses(logit, y)], "heat int, loss double")

    def beliefs(batches):
        for y, logit in map(read, batches):
            yield _batch([y, _belief(logit, net.heat).view(np.int32)], "label int, bits int")

    held = s.keep(_dealt(check, int(size.units.sum())).mapInArrow(logits, LOGITS), "logits")
    loss = {r.heat: r.loss for r in held.mapInArrow(losses, "heat int, loss double").groupBy("heat").agg(F.sum("loss").alias("loss")).collect()}
    net.heat = float(HEATS[min(loss, key=lambda i: (loss[i], i))])
    least = _ranked(held.where(F.col("label") < NONE).mapInArrow(beliefs, "label int, bits int"),
                    {k: _missed(int(v)) for k, v in enumerate(size.versions.sum(axis=0)[:NONE]) if v})
    net.least = tuple(max(LEAST, least[k]) if k in least else 2.0 for k in range(NONE))
    s.drop(held)


def _ranked(beliefs: DataFrame, rank: dict[int, int]) -> dict[int, float]:
    """By label, the belief of that rank (from 0, ascending), exactly: counts
    by the upper, then by all bits (none is negative), at most 2^16 a time."""
    out = {}
    for k, r in rank.items():
        mine = beliefs.where(F.col("label") == k)
        for shift in (16, 0):
            bits = F.shiftright("bits", shift)
            upto = F.sum("count").over(Window.orderBy("b"))
            b, lower = (mine.groupBy(bits.alias("b")).count().select("b", (upto - F.col("count")).alias("lower"))
                        .where(F.col("lower") <= r).orderBy(F.desc("b")).first())
            mine, r = mine.where(bits == b), r - lower
        out[k] = float(np.array(b, np.int32).view(np.float32))
    return out


def fit(docs: DataFrame) -> Net | None:
    """The network for ``docs`` from all its windows; None without any finding."""
    from ..session import Scratch
    s = Scratch(docs.sparkSession)
    windows = s.keep(docs.select("text").mapInArrow(_labelled, WINDOWS).distinct(), "windows")
    size = _size(windows)
    n = int(size.units.sum())
    net = None
    if size.findings():
        if n <= SHARD:
            net = pickle.loads(_dealt(windows, n).mapInArrow(_at_once, "net binary").first().net)
        else:
            net = _over_tasks(s, windows, size)
    s.drop(windows)
    return net


# ---- documents ----------------------------------------------------------

def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def spans_of(buf_all: np.ndarray, off_all: np.ndarray, net: Net | None):
    """(row, base spans, added spans) in code points of every document that
    has either."""
    for p, q in ta.slices(off_all):
        buf, off = buf_all[off_all[p]:off_all[q]], off_all[p:q + 1] - off_all[p]
        found = list(findings(buf, off))
        free = [apart(f) for f in found]
        extra: dict[int, list] = {}
        if net is not None and found:
            doc = np.concatenate([np.full(k.sum(), f.doc) for f, k in zip(found, free)])
            s, e = (np.concatenate([getattr(f, c)[k] for f, k in zip(found, free)]) for c in ("start", "end"))
            prob = _softmax(scores(net, buf, off, doc, s, e) / net.heat)
            kind = prob[:, :NONE].argmax(axis=1)
            sure = 1 - prob[:, NONE] >= np.array(net.least)[kind]
            for i in np.flatnonzero(sure):
                extra.setdefault(int(doc[i]), []).append((int(s[i]), int(kind[i]), int(e[i])))
        for f in found:
            more = extra.get(f.doc, [])
            if f.base or more:
                o = int(off[f.doc])
                cp = ta.code_points(buf[o:int(off[f.doc + 1])])
                yield p + f.doc, *([(int(cp[a - o]), k, int(cp[b - o])) for a, k, b in x] for x in (f.base, more))


def find_secrets(docs: DataFrame, net: Net | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, base counts by kind, base_sha256,
    spans (base and added), n_added. ``net`` defaults to ``fit(docs)``."""
    net = fit(docs) if net is None else net
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            n = len(batch)
            counts = np.zeros((len(KINDS), n), np.int64)
            sha, spans, added = [empty] * n, [""] * n, np.zeros(n, np.int64)
            for i, base, extra in spans_of(*ta.utf8(batch.column(1)), net):
                for _, k, _ in base:
                    counts[k, i] += 1
                sha[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(base + extra)
                added[i] = len(extra)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *map(pa.array, counts), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added)],
                names=[c.split()[0] for c in SCHEMA.split(", ")])
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
