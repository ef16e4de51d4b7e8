"""Quality rules by compression bands (operator 7).

A document is kept when its zstandard ratio (compressed bytes / bytes) over
the whole text lies inside limits that depend on the length, and when at most
``MAX_BAD`` of its bytes stand in chunks outside the limits of a chunk of their
length: a low ratio means repetition, a high one noise. Chunks are near-equal
parts of about ``CHUNK`` bytes that cover the text to its end. Word rules come
first: fewer than 20 words, or over 30 % of the words inside repeated
eight-word windows, reject a document whatever its ratios.

Map-only: one Arrow pass, no shuffle; memory is one slice of a batch.

Defined results: a null text counts as empty (no words, rejected by the word
rule, ratio null); repeated rows each get their own equal row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textarr as ta

MIN_WORDS = 20
MAX_REPEAT_PCT = 30
WINDOW = 8
CHUNK = 512
LEVEL = 3
# Fixed values: (bytes below, lowest ratio, highest ratio); the last row has no upper length.
BANDS = ((256, 0.40, 1.20), (1024, 0.32, 0.90), (4096, 0.26, 0.80), (16384, 0.22, 0.70), (None, 0.18, 0.65))
# Fixed values: (bytes of a chunk below, lowest ratio, highest ratio), and the share of bytes in chunks outside them that a text may have.
CHUNK_BANDS = ((448, 0.34, 0.84), (None, 0.30, 0.80))
MAX_BAD = 0.25

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long")


def _repeated(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True where (group, value) occurs twice or more."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    same = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    hit = np.zeros(len(g), bool)
    hit[1:] |= same
    hit[:-1] |= same
    out = np.zeros(len(g), bool)
    out[order] = hit
    return out


def _later(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True where (group, value) occurred before."""
    order = np.lexsort((value, group))  # stable: ties stay in text order
    g, v = group[order], value[order]
    out = np.zeros(len(g), bool)
    out[order[1:]] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    return out


def line_spans(buf, off):
    """Byte spans of the \\n-split lines of every document, and their document."""
    n_docs = len(off) - 1
    cut = np.flatnonzero(buf == 0x0A)
    start = np.sort(np.concatenate([off[:-1], cut + 1]), kind="stable")
    end = np.sort(np.concatenate([cut, off[1:]]), kind="stable")
    doc = np.repeat(np.arange(n_docs), np.diff(np.searchsorted(cut, off)) + 1)
    return start, end, doc


def measures(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Word, symbol, line and window counts of every document."""
    w = ta.words(buf, off)
    n_words = np.diff(w.first)
    inside = (~ta.IS_SPACE[buf]) & ((buf & 0xC0) != 0x80)
    start, end, doc = line_spans(buf, off)
    has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, doc = start[has_word], end[has_word], doc[has_word]
    dup = _later(doc, ta.segment_hash(buf, start, end))
    pos, group = ta.windows(w.first, WINDOW)
    again = _repeated(group, ta.segment_hash(w.hash, pos, pos + WINDOW))
    cover = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(cover, pos[again], 1)
    np.add.at(cover, pos[again] + WINDOW, -1)
    return {"n_words": n_words, "word_chars": ta.counts(inside, off), "n_symbols": ta.counts(SYMBOL[buf], off),
            "n_dup_lines": np.bincount(doc[dup], minlength=len(off) - 1),
            "n_repeat_words": ta.counts(np.cumsum(cover)[:-1] > 0, w.first)}


def _limits(bands, size: int) -> tuple[float, float]:
    return next((lo, hi) for below, lo, hi in bands if below is None or size < below)


def ratios(data: bytes, zstd) -> tuple[float | None, int, int, int]:
    """Whole ratio, number of chunks, those outside the limits of their
    length, and the bytes in these. A text of one chunk is judged as a whole."""
    if not data:
        return None, 0, 0, 0
    whole = len(zstd.compress(data)) / len(data)
    n = max(1, round(len(data) / CHUNK))
    bad = bad_bytes = 0
    edges = [len(data) * i // n for i in range(n + 1)] if n > 1 else []
    for a, b in zip(edges, edges[1:]):
        low, high = _limits(CHUNK_BANDS, b - a)
        if not low <= len(zstd.compress(data[a:b])) / (b - a) <= high:
            bad, bad_bytes = bad + 1, bad_bytes + b - a
    return whole, n, bad, bad_bytes


def in_bands(size: int, ratio: float | None, n_chunks: int, n_bad: int, bad_bytes: int) -> bool:
    if ratio is None:
        return False
    low, high = _limits(BANDS, size)
    return low <= ratio <= high and bad_bytes <= MAX_BAD * size


def verdicts(buf, off, m, zstd):
    """(word rules failed, kept, ratios) of every document of a slice."""
    r = [ratios(buf[a:b].tobytes(), zstd) for a, b in zip(off[:-1], off[1:])]
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PCT * m["n_words"])
    return failed, [not f and in_bands(int(s), *x) for f, s, x in zip(failed, np.diff(off), r)], r


def _score(batches):
    import zstandard
    zstd = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        buf_all, off_all = ta.utf8(batch.column(1))
        for a, b in ta.slices(off_all):
            off = off_all[a:b + 1] - off_all[a]
            buf = buf_all[off_all[a]:off_all[b]]
            m = measures(buf, off)
            failed, kept, r = verdicts(buf, off, m, zstd)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a).cast(pa.int64()), *(pa.array(v, pa.int64()) for v in m.values()),
                 pa.array(failed), pa.array(kept, pa.bool_()), pa.array([x[0] for x in r], pa.float64()),
                 pa.array([x[1] for x in r], pa.int64()), pa.array([x[2] for x in r], pa.int64())],
                names=[c.split()[0] for c in SCHEMA.split(", ")])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, ratios, verdict."""
    return docs.select("doc_id", "text").mapInArrow(_score, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        import zstandard
        zstd = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            buf_all, off_all = ta.utf8(batch.column(at))
            kept = []
            for a, b in ta.slices(off_all):
                off = off_all[a:b + 1] - off_all[a]
                buf = buf_all[off_all[a]:off_all[b]]
                kept += verdicts(buf, off, measures(buf, off), zstd)[1]
            yield batch.filter(pa.array(kept, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
