"""Personal data with a skip-chain conditional random field (operator 1).

Patterns find the base spans (email, ip, card, phone). The field then labels
tokens (words between ASCII white space) with the same kinds and adds spans
where patterns fail, such as a number whose other mentions are marked.

* Token features come from the characters: digits, @, dots, signs, length.
* Neighbouring tokens share a transition potential; a token and the next
  earlier one that is equal, has the same digits or the same mail host share
  a skip potential, however far apart they stand.
* Loopy sum-product messages run over chains and skips together until the
  beliefs of a whole slice of documents settle.

Tokens without a digit or @ are clamped to "other", so they enter only as
fixed neighbours and messages run over the rest. Weights are trained here by
pseudo-likelihood on texts that the patterns label: all rows are searched, and
of those with a base span of a kind the ``TRAIN_DOCS`` smallest hashes of (id,
text) train, for each kind, and as many of those with a digit or @ but no span.
Of a text longer than ``TRAIN_CHARS`` bytes the stretch around its first span of
the kind trains. The field itself runs over every whole text. Two map passes;
the driver gets at most ``(kinds + 1) x TRAIN_DOCS`` stretches.

The patterns are searched in time that grows with the text: a run of digits or
letters is read once, not once from each of its characters.

Defined results: a null text counts as empty (no spans); repeated rows each
get their own equal row; an empty table, or one without any marked token,
leaves the field untrained and adds nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from . import textarr as ta

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 400
TRAIN_CHARS = 20_000
SURE = 0.6       # belief a token needs
SKIP_PRIOR = 2.0  # agreement over a skip before any is seen
ROUNDS = 30
DAMPING = 0.3

# The patterns of the base spans, with possessive runs and tried
# only where such a run begins, since no match can begin elsewhere in it.
_MAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
MAIL_HERE, MAIL = re.compile(_MAIL), re.compile(r"(?<![A-Za-z0-9._%+-])" + _MAIL)
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
MASKS = {k: f"<{k.upper()}>" for k in KINDS}

SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _holds(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in found.split(".")))
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def mails(text: str):
    """Matches of the email pattern. After one, a run that it ended in may go
    on and begin the next."""
    m = MAIL.search(text)
    while m:
        yield m
        m = MAIL_HERE.match(text, m.end()) or MAIL.search(text, m.end())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, by start, then kind."""
    out = []
    for k, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        found = mails(text) if kind == "email" else PATTERNS[kind].finditer(text)
        out += [(m.start(), k, m.end()) for m in found if _holds(kind, m.group())]
    return sorted(out)


def glued_spans(text: str) -> list[tuple[int, int]]:
    """Matches with more digits than their kind can have: several numbers run
    together, which says nothing about the tokens inside."""
    return [(m.start(), m.end()) for kind, most in (("card", 19), ("phone", 15)) for m in PATTERNS[kind].finditer(text)
            if sum(map(str.isdigit, m.group())) > most]


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


# ---- tokens -----------------------------------------------------------

_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_CORE = _DIGIT | _LETTER
_CORE[list(b"@")] = True


@dataclass
class Tokens:
    """Active tokens of a slice: byte spans of their cores, position among
    the document's words, features, and the edges between them."""
    doc: np.ndarray
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    x: np.ndarray
    chain: np.ndarray  # (2, edges)
    skip: np.ndarray
    left: np.ndarray   # the word before is clamped
    right: np.ndarray


def _sum(flags, start, end):
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[end] - run[start]


def _next_equal(doc: np.ndarray, key: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Edges from each token to the next one of the document with its key."""
    at = np.flatnonzero(ok)
    order = at[np.lexsort((at, key[at], doc[at]))]
    same = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return np.stack([order[:-1][same], order[1:][same]])


def active_tokens(buf: np.ndarray, off: np.ndarray) -> Tokens:
    w = ta.words(buf, off)
    strong = _DIGIT[buf] | (buf == 0x40)
    at = np.flatnonzero(_sum(strong, w.start, w.end) > 0)
    # only these words' bytes are looked at from here on
    doc = np.searchsorted(w.first, at, side="right") - 1
    size = (w.end - w.start)[at]
    first = np.cumsum(size) - size
    pos = np.arange(int(size.sum())) + np.repeat(w.start[at] - first, size)
    b = buf[pos]
    bounds = np.append(first, len(b))
    core = np.where(_CORE[b], np.arange(len(b)), -1)
    hi = np.maximum.reduceat(core, first) + 1 if len(at) else first
    lo = np.minimum.reduceat(np.where(core < 0, len(b), core), first) if len(at) else first
    plus = (b == 0x2B) | (b == 0x28)  # an opening + or ( belongs to a number
    lead = plus[np.maximum(lo - 1, 0)] & (lo > first)
    lo = lo - lead
    lead = (b[np.maximum(lo - 1, 0)] == 0x2B) & (lo > first)
    lo = lo - lead
    digit, letter = _DIGIT[b], _LETTER[b]

    def n(flags):
        return _sum(flags, bounds[:-1], bounds[1:])
    digits, letters, dots, dashes, ats = n(digit), n(letter), n(b == 0x2E), n(b == 0x2D), n(b == 0x40)
    inner_dots = _sum(b == 0x2E, lo, hi)
    one = np.ones(len(at), bool)
    columns = [one, ats == 1, ats > 1, (ats == 1) & (inner_dots > 0), (ats == 1) & (letters > 0),
               (b[lo] == 0x2B) if len(at) else one, (b[lo] == 0x28) if len(at) else one, n(b == 0x29) > 0,
               (letters == 0) & (ats == 0), (letters > 0) & (ats == 0)]
    columns += [(ats == 0) & (digits == i) for i in range(1, 8)]
    columns += [(ats == 0) & (digits >= 8) & (digits < 12), (ats == 0) & (digits >= 12) & (digits < 14),
                (ats == 0) & (digits >= 14) & (digits < 20), (ats == 0) & (digits >= 20)]
    columns += [(ats == 0) & (inner_dots == i) & (letters == 0) for i in (1, 2, 3, 4)]
    columns += [(dashes == 1) & (letters == 0), (dashes == 2) & (letters == 0), (dashes == 3) & (letters == 0), dots - inner_dots > 0]
    x = np.stack(columns, axis=1).astype(np.float32) if len(at) else np.zeros((0, 29), np.float32)

    near = (at[1:] == at[:-1] + 1) & (doc[1:] == doc[:-1])
    chain = np.stack([np.flatnonzero(near), np.flatnonzero(near) + 1])
    left, right = np.ones(len(at), bool), np.ones(len(at), bool)
    left[chain[1]] = right[chain[0]] = False
    left &= at > w.first[doc]
    right &= at + 1 < w.first[doc + 1]
    lower = np.where((b >= 0x41) & (b <= 0x5A), b + 32, b).astype(np.uint8)
    exact = ta.segment_hash(lower, lo, hi)
    number = ta.segment_hash(b[digit], _sum(digit, np.zeros_like(first), first), _sum(digit, np.zeros_like(first), bounds[1:]))
    mark = np.maximum.reduceat(np.where(b == 0x40, np.arange(len(b)), -1), first) if len(at) else first
    host = ta.segment_hash(lower, np.minimum(np.maximum(mark, lo), hi), hi)
    skips = [_next_equal(doc, exact, one), _next_equal(doc, number, digits >= 7), _next_equal(doc, host, ats == 1)]
    skip = np.unique(np.concatenate(skips, axis=1), axis=1)
    move = w.start[at] - first
    return Tokens(doc, at - w.first[doc], lo + move, hi + move, x, chain, skip, left, right)


# ---- field ------------------------------------------------------------

@dataclass
class Field:
    """Weights: features x labels, transitions, agreement over a skip. Label
    0 is "other"."""
    unary: np.ndarray
    chain: np.ndarray
    skip: float


def _softmax(s):
    s = np.exp(s - s.max(axis=1, keepdims=True))
    return s / s.sum(axis=1, keepdims=True)


def train(tokens: list[Tokens], labels: list[np.ndarray], steps: int = 1500, rate: float = 1.0, decay: float = 1e-5,
          chain_decay: float = 2e-3) -> Field | None:
    """Pseudo-likelihood: every token's label given its neighbours' labels,
    by gradient ascent with momentum on all tokens at once. Transitions are
    held smaller than features: pseudo-likelihood overrates them, as it sees
    the neighbours' true labels. The ridge pulls
    weights to 0 and the skip potential to SKIP_PRIOR, which stays where a
    corpus has no repeated mentions to learn it from."""
    k = len(KINDS) + 1
    base = np.cumsum([0] + [len(t.doc) for t in tokens])
    y = np.concatenate(labels) if labels else np.zeros(0, np.int64)
    if not (y > 0).any():
        return None
    x = np.concatenate([t.x for t in tokens])
    chain = np.concatenate([t.chain + b for t, b in zip(tokens, base)], axis=1)
    skip = np.concatenate([t.skip + b for t, b in zip(tokens, base)], axis=1)
    left, right = (np.concatenate([getattr(t, s) for t in tokens]) for s in ("left", "right"))
    one = np.concatenate([np.eye(k), np.zeros((1, k))])  # unknown labels (-1) say nothing
    known = (y >= 0)[:, None]
    before, after, linked = np.zeros((3, len(y), k))
    before[left], after[right] = one[0], one[0]
    before[chain[1]], after[chain[0]] = one[y[chain[0]]], one[y[chain[1]]]
    np.add.at(linked, skip[0], one[y[skip[1]]])
    np.add.at(linked, skip[1], one[y[skip[0]]])
    n, target = len(y), one[y]
    u, c, s = np.zeros((x.shape[1], k)), np.zeros((k, k)), SKIP_PRIOR
    mu, mc, ms = np.zeros_like(u), np.zeros_like(c), 0.0
    for _ in range(steps):
        err = known * (target - _softmax(x @ u + before @ c + after @ c.T + s * linked))
        mu = 0.9 * mu + x.T @ err / n - decay * u
        mc = 0.9 * mc + (before.T @ err + err.T @ after) / n - chain_decay * c
        ms = 0.9 * ms + (err * linked).sum() / n - decay * (s - SKIP_PRIOR)
        u, c, s = u + rate * mu, c + rate * mc, s + rate * ms
    return Field(u, c, max(s, 0.0))


def beliefs(t: Tokens, f: Field) -> np.ndarray:
    """Marginals of every active token by loopy sum-product, in parallel
    over all documents of the slice."""
    k = f.chain.shape[0]
    unary = t.x @ f.unary
    unary[t.left] += f.chain[0]
    unary[t.right] += f.chain[:, 0]
    agree = np.eye(k) * f.skip
    src = np.concatenate([t.chain[0], t.chain[1], t.skip[0], t.skip[1]])
    dst = np.concatenate([t.chain[1], t.chain[0], t.skip[1], t.skip[0]])
    table = np.stack([np.exp(f.chain), np.exp(f.chain.T), np.exp(agree)])
    which = np.repeat([0, 1, 2], [t.chain.shape[1], t.chain.shape[1], 2 * t.skip.shape[1]])
    half = np.concatenate([t.chain.shape[1] + np.arange(t.chain.shape[1]), np.arange(t.chain.shape[1]),
                           2 * t.chain.shape[1] + t.skip.shape[1] + np.arange(t.skip.shape[1]),
                           2 * t.chain.shape[1] + np.arange(t.skip.shape[1])])  # the opposite message
    msg = np.zeros((len(src), k))
    for _ in range(ROUNDS if len(src) else 0):
        total = unary.copy()
        np.add.at(total, dst, msg)
        out = total[src] - msg[half]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.empty_like(msg)
        for w in range(3):
            m = which == w
            new[m] = np.log(out[m] @ table[w] + 1e-300)
        new -= new.max(axis=1, keepdims=True)
        moved = np.abs(new - msg).max()
        msg = DAMPING * msg + (1 - DAMPING) * new
        if moved < 1e-4:
            break
    np.add.at(unary, dst, msg)
    return _softmax(unary)


# ---- documents --------------------------------------------------------

def _slice(buf_all, off_all, a, b):
    off = off_all[a:b + 1] - off_all[a]
    buf = buf_all[off_all[a]:off_all[b]]
    t = active_tokens(buf, off)
    bounds = np.searchsorted(t.doc, np.arange(b - a + 1))
    return buf, off, t, bounds


def _covered(raw, cp, t, lo, hi, o, base):
    """Label of each token lo:hi of a document by the base spans it meets
    (first in order), 0 for none; code point spans of the tokens."""
    s, e = cp[t.start[lo:hi] - o], cp[t.end[lo:hi] - o]
    y = np.zeros(hi - lo, np.int64)
    for x, k, z in reversed(base):
        i, j = np.searchsorted(e, x, side="right"), np.searchsorted(s, z)
        y[i:j] = k + 1
    return s, e, y


def _added(s, e, word, labels, base) -> list[tuple[int, int, int]]:
    """Spans of runs of one label that touch no base span."""
    out, i = [], 0
    while i < len(labels):
        j = i + 1
        while j < len(labels) and labels[j] == labels[i] and word[j] == word[j - 1] + 1 and labels[i]:
            j += 1
        if labels[i] and not any(x < e[j - 1] and s[i] < z for x, _, z in base):
            out.append((int(s[i]), int(labels[i]) - 1, int(e[j - 1])))
        i = j
    return out


def spans_of(buf_all, off_all, field: Field | None):
    """(row, text, base spans, added spans) of every document that has an
    active token; all others have no spans."""
    for a, b in ta.slices(off_all):
        buf, off, t, bounds = _slice(buf_all, off_all, a, b)
        labels = np.zeros(len(t.doc), np.int64)
        if field is not None and len(t.doc):
            p = beliefs(t, field)
            labels = np.where(p.max(axis=1) >= SURE, p.argmax(axis=1), 0)
        for d in np.flatnonzero(np.diff(bounds)):
            raw = buf[off[d]:off[d + 1]]
            text = raw.tobytes().decode()
            base = base_spans(text)
            lo, hi = bounds[d], bounds[d + 1]
            extra = []
            if labels[lo:hi].any():
                s, e, y = _covered(raw, ta.code_points(raw), t, lo, hi, off[d], base)
                extra = _added(s, e, t.word[lo:hi], np.where(y > 0, 0, labels[lo:hi]), base)
            yield a + int(d), text, base, extra


def examples(texts: list[str]):
    """Tokens and pattern labels of training texts (-1: unknown)."""
    buf_all, off_all = ta.utf8(pa.array(texts, pa.large_string()))
    tokens, labels = [], []
    for a, b in ta.slices(off_all):
        buf, off, t, bounds = _slice(buf_all, off_all, a, b)
        y = np.zeros(len(t.doc), np.int64)
        for d in np.flatnonzero(np.diff(bounds)):
            raw = buf[off[d]:off[d + 1]]
            lo, hi = bounds[d], bounds[d + 1]
            text = raw.tobytes().decode()
            s, e, y[lo:hi] = _covered(raw, ta.code_points(raw), t, lo, hi, off[d], base_spans(text))
            for p, q in glued_spans(text):
                inside = np.flatnonzero((e > p) & (s < q)) + lo
                y[inside[y[inside] == 0]] = -1
        tokens.append(t)
        labels.append(y)
    return tokens, labels


OTHER = len(KINDS)  # label of texts with active tokens but no base span


def _labels(batches):
    """Per task and label, the smallest hashes of texts that have it."""
    heaps: list[list[int]] = [[] for _ in range(OTHER + 1)]

    def offer(label, h):
        heap = heaps[label]
        if len(heap) < TRAIN_DOCS:
            heapq.heappush(heap, -h)
        elif -heap[0] > h:
            heapq.heapreplace(heap, -h)

    for batch in batches:
        keys = batch.column(0).to_numpy()
        buf_all, off_all = ta.utf8(batch.column(1))
        strong = _DIGIT[buf_all] | (buf_all == 0x40)
        for d in np.flatnonzero(np.diff(np.searchsorted(np.flatnonzero(strong), off_all))):
            text = buf_all[off_all[d]:off_all[d + 1]].tobytes().decode()
            for label in {k for _, k, _ in base_spans(text)} or {OTHER}:
                offer(label, int(keys[d]))
    rows = [(y, -h) for y in range(OTHER + 1) for h in set(heaps[y])]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], names=["label", "key"])


def _stretches(wanted: dict[int, list[int]]):
    """(label, key, stretch) of the wanted texts."""
    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = base_spans(text) if len(text) > TRAIN_CHARS else ()
                for label in wanted.get(key, ()):
                    at = next((a for a, k, _ in spans if k == label), 0)
                    cut = text.rfind(" ", 0, max(0, at - TRAIN_CHARS // 2)) + 1  # whole words
                    rows.append((label, key, text[cut:cut + TRAIN_CHARS]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.int32(), pa.int64(), pa.string()))],
                                             names=["label", "key", "text"])
    return run


def fit(docs: DataFrame) -> Field | None:
    """The field's weights from a bounded sample (see the module text). A text
    with spans of several kinds trains once."""
    s = Scratch(docs.sparkSession)
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").where("text is not null")
    found = s.keep(keyed.where(F.col("text").rlike("[0-9@]")).mapInArrow(_labels, "label int, key long"), "labels")
    wanted: dict[int, list[int]] = {}
    for y in range(OTHER + 1):
        for r in found.where(F.col("label") == y).distinct().orderBy("key").limit(TRAIN_DOCS).collect():
            wanted.setdefault(r.key, []).append(y)
    s.drop(found)
    rows = keyed.where(F.col("key").isin(list(wanted))).mapInArrow(_stretches(wanted), "label int, key long, text string").distinct()
    return train(*examples(sorted({r.text for r in rows.collect()})))


def _find(field):
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            n = len(batch)
            counts = np.zeros((len(KINDS), n), np.int64)
            sha, spans, added = [empty] * n, [""] * n, np.zeros(n, np.int64)
            for i, _, base, extra in spans_of(*ta.utf8(batch.column(1)), field):
                for _, k, _ in base:
                    counts[k, i] += 1
                sha[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(base + extra)
                added[i] = len(extra)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *map(pa.array, counts), pa.array(sha), pa.array(spans), pa.array(added)],
                names=[c.split()[0] for c in SCHEMA.split(", ")])
    return run


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, base counts by kind, base_sha256,
    spans (base and added), n_added. ``field`` defaults to ``fit(docs)``."""
    field = fit(docs) if field is None else field
    return docs.select("doc_id", "text").mapInArrow(_find(field), SCHEMA)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind's mark; of overlapping
    spans the first (the longer at a tie) names the whole stretch."""
    out, at, last = [], 0, None
    for a, k, b in sorted(spans, key=lambda s: (s[0], -s[2], s[1])):
        if last is not None and a < at:
            at = max(at, b)
            continue
        out += [text[at:a], MASKS[KINDS[k]]]
        at, last = b, k
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with spans in ``text`` replaced by marks; null stays null,
    all other columns pass through."""
    field = fit(docs) if field is None else field
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            found = {i: masked(text, base + extra) for i, text, base, extra in spans_of(*ta.utf8(column), field) if base or extra}
            if found:
                new = [found.get(i, v) for i, v in enumerate(column.to_pylist())]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, column.type))
            yield batch
    return docs.mapInArrow(run, docs.schema)
