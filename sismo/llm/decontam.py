"""Benchmark decontamination by q-gram lemma filtering (operator 2).

Texts and items are lower-cased and white space becomes single spaces. Every
benchmark item is cut into overlapping windows of ``WINDOW`` code points. A
window stands in a document when some region lies within its edit budget: one
edit per ``PER_EDIT`` code points, or as many as leave a q-gram that must be
shared (one edit instead of two for items of 32 to 35 code points). By the
q-gram lemma such a region shares at least (length - q + 1) - edits * q
q-grams with the window, on diagonals that differ by at most the budget. So the operator counts shared q-grams in
overlapping diagonal bands, keeps the bands that reach the bound, and
verifies each by banded alignment. The filter loses nothing, the alignment
admits nothing beyond the budget. With ``short_items`` (as op2 and the
pipeline call it), items under ``SHORTEST`` code points stand in a document
when it holds them exactly as whole words: no letter, mark or digit goes on
across either end (scripts written without spaces have a word boundary at
every character). Without it they are not searched.

Plan: the item index is broadcast in blocks of about ``INDEX_CHARS`` characters
(about 80 bytes of index a character). With one block the operator is map-only
over the documents. A larger benchmark gets a pass for every block, so a task
never holds more than one; only (doc_id, hash of the text) of texts with an item
come out of these passes and are joined back to the rows.

Defined results: null texts count as empty; items without any text are not
searched; items with a null item_id contaminate like all others, count
together as one in n_items and have no name in item_ids; repeated rows each
get their own equal row; empty tables give empty or all-clean results; other
columns are ignored.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarr as ta

Q = 12
WINDOW = 64
STRIDE = 16
PER_EDIT = 16
SHORTEST = 24
INDEX_CHARS = 4_000_000
_BITS = 20
_NONE = np.uint32(0xFFFFFFFF)  # no code point: outside the document

# Code points of scripts written without spaces (Thai to Lao, Myanmar, Khmer, kana, Han, ...).
_UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0x3100), (0x31F0, 0x3200), (0x3400, 0xA000),
             (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x32000))

TEXT = "_text_hash"
STATE = f"doc_id long, {TEXT} long, items array<long>, edits int"


def normalise(column) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of lower-cased texts, white space runs as one
    space and none at the ends."""
    if column.null_count:
        column = column.fill_null("")
    buf, off = ta.utf8(pc.utf8_lower(column.cast(pa.large_string())))
    if len(buf) == 0:
        return np.zeros(0, np.uint32), off
    space = ta.IS_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    drop = space.copy()  # a space stays only when a word goes before it and one follows
    drop[1:] &= space[:-1] | edge[1:-1]
    drop[0] = space[0]
    keep = ~drop
    left = np.where(space, np.uint8(0x20), buf)[keep]
    at = np.concatenate([[0], np.cumsum(keep)])[off]
    tail = at[1:][(np.diff(at) > 0)] - 1
    tail = tail[left[tail] == 0x20]
    if len(tail):
        ok = np.ones(len(left), bool)
        ok[tail] = False
        at = np.concatenate([[0], np.cumsum(ok)])[at]
        left = left[ok]
    points = np.frombuffer(left.tobytes().decode().encode("utf-32-le"), np.uint32)
    return points, ta.code_points(left)[at]


def gram_hashes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q code points from each position on (the last q - 1
    positions have none)."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for i in range(0, n, ta.BLOCK // 2):
        m = min(ta.BLOCK // 2, n - i)
        start = np.arange(m)
        out[i:i + m] = ta.segment_hash(points[i:i + m + q - 1], start, start + q)
    return out


@functools.cache
def word_points() -> np.ndarray:
    """Which code points belong to words: letters, marks, digits, _."""
    out = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    out[ord("_")] = True
    for a, b in _UNSPACED:
        out[a:b] = False
    return out


@dataclass
class Index:
    """Windows of a block of items and the q-grams in them; short items by
    their length, as (sorted hashes, their code points, their items)."""
    ids: list            # item_id of each item, may be None
    short: dict
    points: np.ndarray   # (windows, WINDOW), padded
    length: np.ndarray
    item: np.ndarray
    budget: np.ndarray
    bound: np.ndarray    # q-grams that must be shared
    grams: np.ndarray    # sorted distinct hashes
    first: np.ndarray    # postings of gram g: first[g]:first[g + 1]
    window: np.ndarray
    offset: np.ndarray
    table: np.ndarray    # bit table over the top bits of the hashes


def build_index(items: list[tuple[int | None, str]], short_items: bool = False) -> Index | None:
    wins, owner, whole = [], [], {}
    points, off = normalise(pa.array([t for _, t in items], pa.large_string()))
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        if b - a < SHORTEST:
            if short_items and b > a:
                whole.setdefault(b - a, []).append((a, i))
            continue
        starts = [a] if b - a <= WINDOW else sorted({*range(a, b - WINDOW + 1, STRIDE), b - WINDOW})
        for s in starts:
            wins.append(points[s:min(s + WINDOW, b)])
            owner.append(i)
    if not wins and not whole:
        return None
    short = {}
    for n, found in whole.items():
        a, i = np.array(found).T
        h = ta.segment_hash(points, a, a + n)
        order = np.argsort(h, kind="stable")
        short[n] = h[order], points[a[order, None] + np.arange(n)], i[order]
    length = np.array([len(w) for w in wins], np.int64)
    budget = np.minimum(length // PER_EDIT, length // Q - 1)  # the bound stays positive
    bound = length - Q + 1 - budget * Q
    padded = np.full((len(wins), WINDOW), _NONE, np.uint32)
    for row, w in zip(padded, wins):
        row[:len(w)] = w
    h = [gram_hashes(w) for w in wins]
    flat = np.concatenate([np.zeros(0, np.uint64), *h])
    window = np.repeat(np.arange(len(wins)), np.array([len(x) for x in h], np.int64))
    offset = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in h)])
    order = np.argsort(flat, kind="stable")
    grams, first = np.unique(flat[order], return_index=True)
    table = np.zeros(1 << _BITS, bool)
    table[(grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return Index([i for i, _ in items], short, padded, length, np.array(owner, np.int64), budget, bound, grams, np.append(first, len(flat)),
                 window[order], offset[order], table)


def dense(pos: np.ndarray, least: int, span: int) -> np.ndarray:
    """Which sorted positions lie in a group of ``least`` within ``span``."""
    if least <= 1 or len(pos) < least:
        return np.full(len(pos), least <= 1)
    near = pos[least - 1:] - pos[:len(pos) - least + 1] <= span
    cover = np.zeros(len(pos) + 1, np.int64)
    at = np.flatnonzero(near)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + least, -1)
    return np.cumsum(cover)[:-1] > 0


def align(points, lo_bound, hi_bound, start, width, windows, length, most):
    """Least edits between each window and a region of the document text
    points[lo_bound:hi_bound] that starts on one of the diagonals
    start .. start + width - 1, as banded dynamic programming over all
    candidates at once. Values beyond ``most`` are not exact."""
    n, rows = windows.shape
    d = np.arange(width)
    row = np.zeros((n, width), np.int16)  # a region may start on any diagonal
    best = np.full(n, 1 << 14, np.int16)
    for i in range(rows):
        at = start[:, None] + d + i
        inside = (at >= lo_bound[:, None]) & (at < hi_bound[:, None])
        char = np.where(inside, points[np.clip(at, 0, len(points) - 1)], _NONE - np.uint32(1))
        new = row + (char != windows[:, i:i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)  # window character left out
        new = np.minimum.accumulate(new - d, axis=1) + d       # extra text character
        row = new.astype(np.int16)
        end = length == i + 1
        if end.any():
            best[end] = row[end].min(axis=1)
    return best


def search(points: np.ndarray, off: np.ndarray, ix: Index):
    """(document, item, edits) of every match in a slice of documents; items
    as places in ``ix.ids``."""
    doc, window, edits = search_windows(points, off, ix)
    parts = [(doc, ix.item[window], edits), *search_short(points, off, ix)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def search_short(points: np.ndarray, off: np.ndarray, ix: Index):
    """Matches of the short items, as whole words, by item length."""
    if not ix.short or len(points) == 0:
        return
    word = word_points()[points]
    edge = np.ones(len(points) + 1, bool)
    edge[1:-1] = ~(word[1:] & word[:-1])
    edge[off] = True
    for n, (hashes, texts, items) in ix.short.items():
        for i in range(0, len(points) - n + 1, ta.BLOCK // 2):
            part = points[i:i + ta.BLOCK // 2 + n - 1]
            start = np.flatnonzero(edge[i:i + len(part) - n + 1] & edge[i + n:i + len(part) + 1])
            h = ta.segment_hash(part, start, start + n)
            lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            size = hi - lo
            at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            start = np.repeat(start, size)
            doc = np.searchsorted(off, i + start, side="right") - 1
            ok = (i + start + n <= off[doc + 1]) & (part[start[:, None] + np.arange(n)] == texts[at]).all(axis=1)
            yield doc[ok], items[at[ok]], np.zeros(int(ok.sum()), np.int64)


def search_windows(points: np.ndarray, off: np.ndarray, ix: Index):
    """(document, window, edits) of every matching window."""
    none = np.zeros(0, np.int64)
    if len(ix.length) == 0:
        return none, none, none
    h = gram_hashes(points)
    pos = np.flatnonzero(ix.table[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
    if len(pos) == 0:
        return none, none, none
    at = np.searchsorted(ix.grams, h[pos])
    at[at == len(ix.grams)] = 0
    ok = ix.grams[at] == h[pos]
    doc = np.searchsorted(off, pos, side="right") - 1
    ok &= pos + Q <= off[doc + 1]
    pos, at, doc = pos[ok], at[ok], doc[ok]
    ok = dense(pos, int(ix.bound.min()), WINDOW + int(ix.budget.max()))
    pos, at, doc = pos[ok], at[ok], doc[ok]
    if len(pos) == 0:
        return none, none, none
    size = ix.first[at + 1] - ix.first[at]
    post = np.repeat(ix.first[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    window = ix.window[post]
    diagonal = np.repeat(pos, size) - ix.offset[post]
    doc = np.repeat(doc, size)
    # two grids of bands, shifted by half: any run of budget + 1 diagonals lies in one band whole
    half = int(ix.budget.max()) + 1
    band = np.concatenate([diagonal // (2 * half) * 2, (diagonal + half) // (2 * half) * 2 - 1])
    window, doc = np.tile(window, 2), np.tile(doc, 2)
    order = np.lexsort((band, window, doc))
    key = np.stack([doc[order], window[order], band[order]])
    head = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
    count = np.diff(np.append(head, key.shape[1]))
    doc, window, band = key[:, head]
    ok = count >= ix.bound[window]
    doc, window, band = doc[ok], window[ok], band[ok]
    edits = np.zeros(len(doc), np.int64)
    k = int(ix.budget.max())
    for i in range(0, len(doc), 20_000):
        d, w, b = doc[i:i + 20_000], window[i:i + 20_000], band[i:i + 20_000]
        edits[i:i + 20_000] = align(points, off[d], off[d + 1], b * half - k, 2 * half + 2 * k, ix.points[w], ix.length[w], k)
    ok = edits <= ix.budget[window]
    return doc[ok], window[ok], edits[ok]


def _by_id(item_id):
    return item_id is None, item_id or 0


def _found(batch, column, ix):
    """Items and fewest edits of each row of a batch: (sets, least)."""
    _, off_all = ta.utf8(batch.column(column))
    found, least = [set() for _ in range(len(batch))], [None] * len(batch)
    for a, b in ta.slices(off_all):
        points, off = normalise(batch.column(column).slice(a, b - a))
        for d, i, e in zip(*(x.tolist() for x in search(points, off, ix))):
            found[a + d].add(ix.ids[i])
            least[a + d] = e if least[a + d] is None else min(e, least[a + d])
    return found, least


def _step(shared, hits_only=False):
    """Adds items and edits to (doc_id, text key, text); only rows with an item
    if ``hits_only``."""
    def run(batches):
        ix = shared.value
        for batch in batches:
            found, least = _found(batch, 2, ix)
            rows = [i for i, x in enumerate(found) if x or not hits_only]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array([sorted(found[i], key=_by_id) for i in rows], pa.list_(pa.int64())),
                 pa.array([least[i] for i in rows], pa.int32())], names=["doc_id", TEXT, "items", "edits"])
    return run


def _blocks(benchmark: DataFrame, short_items: bool):
    """Indexes over blocks of about INDEX_CHARS characters of items each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-chars // INDEX_CHARS)
    for b in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()
        index = build_index(sorted(((r.item_id, r.text) for r in part), key=lambda x: (_by_id(x[0]), x[1])), short_items)
        if index is not None:
            yield index


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the hash of each text: (doc_id, hash) names a text."""
    return docs.withColumn(TEXT, F.xxhash64("text"))


def _same_text(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a[TEXT] == b[TEXT])


def _hits(rows: DataFrame, indexes: list) -> DataFrame:
    """(doc_id, text hash, items, edits) of the texts that hold an item of any
    index. Every index has a pass of its own, so a task holds one at a time."""
    parts = [rows.mapInArrow(_step(x, True), STATE) for x in indexes]
    each = functools.reduce(DataFrame.union, parts).select("doc_id", TEXT, F.explode("items").alias("item"), "edits")
    # a set of items, at most those of the benchmark, however often a text is repeated
    return (each.groupBy("doc_id", TEXT).agg(F.collect_set(F.struct("item")).alias("found"), F.min("edits").alias("edits"))
            .select("doc_id", TEXT, F.transform("found", lambda x: x.item).alias("items"), "edits"))


def _shared(docs: DataFrame, benchmark: DataFrame, short_items: bool) -> list:
    context = docs.sparkSession.sparkContext
    return [context.broadcast(index) for index in _blocks(benchmark, short_items)]  # about INDEX_CHARS of items each


def find_contamination(docs: DataFrame, benchmark: DataFrame, short_items: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, item_ids
    (ascending, comma-joined), min_edits (null when clean)."""
    indexes = _shared(docs, benchmark, short_items)
    rows = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", TEXT, "text")
    if not indexes:
        out = rows.select("doc_id", F.array().cast("array<long>").alias("items"), F.lit(None).cast("int").alias("edits"))
    elif len(indexes) == 1:
        out = rows.mapInArrow(_step(indexes[0]), STATE)
    else:
        hits, keys = _hits(rows, indexes), rows.select("doc_id", TEXT)
        out = keys.join(hits, _same_text(keys, hits), "left").select(keys["doc_id"], F.coalesce("items", F.array()).alias("items"), "edits")
    ids = F.concat(F.filter("items", lambda x: x.isNull()), F.sort_array(F.filter("items", lambda x: x.isNotNull())))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"),
                      F.concat_ws(",", ids.cast("array<string>")).alias("item_ids"),
                      F.col("edits").cast("long").alias("min_edits"))


def _clean(shared, at):
    def run(batches):
        ix = shared.value
        for batch in batches:
            yield batch.filter(pa.array([not x for x in _found(batch, at, ix)[0]], pa.bool_()))
    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, short_items: bool = False) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all their
    columns."""
    indexes = _shared(docs, benchmark, short_items)
    if not indexes:
        return docs
    if len(indexes) == 1:
        return docs.mapInArrow(_clean(indexes[0], docs.columns.index("text")), docs.schema)
    rows = _keyed(docs)
    hits = _hits(rows.select(F.col("doc_id").cast("long").alias("doc_id"), TEXT, "text"), indexes)
    return rows.join(hits, _same_text(rows, hits), "left_anti").select(docs.columns)
