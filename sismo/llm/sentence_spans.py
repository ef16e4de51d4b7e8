"""Substring deduplication by sliding sentence spans (operator 10).

A text is cut into sentences: after a stop before white space, also when
closing quotes or brackets stand between the two, and at every line feed
(``STOPS``, ``FULL_STOPS`` and ``CLOSERS`` list the marks). Words are cut at
ASCII white space, so text in a script without spaces is one word. Every run of consecutive sentences that is just long enough is
hashed on its words: from each sentence on, and up to each sentence, the
shortest run of two or more sentences with ``MIN_WORDS`` words, or a single
sentence of twice as many. Both directions together guarantee that of any
shared passage of at least twice ``MIN_WORDS`` words every whole sentence
lies in a run that is shared as well. What is not found: at an edge where the
passage has no boundary of its own (unterminated text before or after it), its
first or last sentence merges with the neighbouring text, and the guarantee
holds for the sentences between.

Runs are joined globally by hash; the first place of a hash is the smallest
(doc_id, sentence). Sentences covered by any run that stands there not for
the first time are removed, with the white space before them.

Plan: one Arrow pass emits for each run its hash and place. Inside a batch
only the smallest place of a hash goes on to the shuffle: all others are
known repeats at once, so a passage in a third of all rows costs one row per
batch. One shuffle on the hash finds the repeats between batches, one on the
id brings the spans back to the texts.

Defined results: null texts count as empty and come back null; rows with a
null doc_id are never repeats and no one's first place, and come back whole;
rows that repeat an id and its text are one document (they share its place
and its spans); rows of one id with different texts are told apart by their
text and the text hash breaks ties between them; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Scratch
from . import textarr as ta

MIN_WORDS = 25

# Marks that end a sentence, ASCII and others, and marks that may follow them.
STOPS = ".!?"
FULL_STOPS = "\u3002\uff01\uff1f\uff0e\uff61\u2026\u203c\u203d\u2047\u2048\u2049\u061f\u06d4\u0964\u0965\u0589\u1362\u1367\u104b\u17d4\u17d5"
CLOSERS = ("\"')]}\u00bb\u00ab\u2019\u2018\u201d\u201c\u203a\u2039\u300d\u300f\u3009\u300b\u3011\u3015\u3017\u3019\u301b\u301e\u301f"
           "\uff02\uff07\uff09\uff3d\uff5d\uff60\uff63")


def _codes(marks: str) -> np.ndarray:
    """UTF-8 bytes of each mark as one number."""
    return np.array(sorted(int.from_bytes(c.encode(), "big") for c in marks))


_STOP_CODES, _CLOSER_CODES = _codes(STOPS + FULL_STOPS), _codes(CLOSERS)
_STOP = np.zeros(256, bool)
_STOP[list(STOPS.encode())] = True
_LAST = np.zeros(256, bool)  # bytes that the other marks end in
_LAST[np.concatenate([_codes(FULL_STOPS), _CLOSER_CODES]) & 0xFF] = True
STEPS = 8  # marks taken off many words at once; longer rows of them word by word


def ends_sentence(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which words end in a stop, or in a stop and closing marks."""
    out = _STOP[buf[end - 1]]
    at = np.flatnonzero(_LAST[buf[end - 1]])
    e = end[at]
    for _ in range(STEPS):
        if len(at) == 0:
            return out
        b = buf[np.maximum(e[:, None] - [1, 2, 3], 0)].astype(np.int64)
        size = np.where(b[:, 0] < 0x80, 1, np.where(b[:, 1] >= 0xC0, 2, 3))
        code = b[:, 0] | np.where(size > 1, b[:, 1] << 8, 0) | np.where(size > 2, b[:, 2] << 16, 0)
        out[at[np.isin(code, _STOP_CODES)]] = True
        more = np.isin(code, _CLOSER_CODES) & (e - size > start[at])
        at, e = at[more], (e - size)[more]
    for i, x in zip(at.tolist(), e.tolist()):
        left = buf[start[i]:x].tobytes().decode().rstrip(CLOSERS)
        out[i] = left.endswith(tuple(STOPS + FULL_STOPS))
    return out


def sentences(buf: np.ndarray, off: np.ndarray):
    """Word table and sentences of all documents: (words, first word of each
    sentence plus the total, first sentence of each document plus the total).
    A sentence begins at a document's first word, after a word that ends in
    a stop (and closing marks) and after white space holding a line feed."""
    w = ta.words(buf, off)
    n = len(w.start)
    begins = np.zeros(n + 1, bool)
    begins[w.first[:-1]] = True
    if n:
        begins[1:n] |= ends_sentence(buf, w.start[:-1], w.end[:-1])
        lines = np.searchsorted(np.flatnonzero(buf == 0x0A), w.start)
        begins[1:n] |= lines[1:] != lines[:-1]
    first_word = np.concatenate([np.flatnonzero(begins[:n]), [n]])
    return w, first_word, np.searchsorted(first_word[:-1], w.first)


def runs(first_word: np.ndarray, first_sentence: np.ndarray, least: int):
    """(document, first sentence, last + 1) of every run, each once."""
    n = len(first_word) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    doc = np.repeat(np.arange(len(first_sentence) - 1), np.diff(first_sentence))
    i = np.arange(n)
    size = np.diff(first_word)
    lo, hi = first_sentence[doc], first_sentence[doc + 1]
    # from sentence i on: smallest end with enough words
    end = np.maximum(np.searchsorted(first_word, first_word[:-1] + least), i + 2)
    end = np.where(size >= 2 * least, i + 1, end)
    fits = end <= hi
    a, b, d = i[fits], end[fits], doc[fits]
    # up to sentence i: largest start with enough words
    start = np.minimum(np.searchsorted(first_word, first_word[1:] - least, side="right") - 1, i - 1)
    start = np.where(size >= 2 * least, i, start)
    fits = start >= lo
    a, b, d = (np.concatenate(p) for p in ((a, start[fits]), (b, i[fits] + 1), (d, doc[fits])))
    order = np.lexsort((b, a))
    a, b, d = a[order], b[order], d[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return d[new], a[new], b[new]


RUNS = "doc_id long, text_key long, first int, last int, hash long, repeat boolean"


def _spans(least):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            keys = batch.column(1).cast(pa.int64()).to_numpy(zero_copy_only=False)
            buf_all, off_all = ta.utf8(batch.column(2))
            parts = []
            for x, y in ta.slices(off_all):
                off = off_all[x:y + 1] - off_all[x]
                w, first_word, first_sentence = sentences(buf_all[off_all[x]:off_all[y]], off)
                d, a, b = runs(first_word, first_sentence, least)
                h = ta.segment_hash(w.hash, first_word[a], first_word[b]).view(np.int64)
                base = first_sentence[d]
                ok = known[x + d]
                parts.append([p[ok] for p in (ids[x + d], keys[x + d], (a - base), (b - base), h)])
            if not parts:
                continue
            doc, key, a, b, h = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((a, key, doc, h))
            doc, key, a, b, h = doc[order], key[order], a[order], b[order], h[order]
            head = np.ones(len(h), bool)
            head[1:] = h[1:] != h[:-1]
            lead = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
            again = (doc != doc[lead]) | (key != key[lead]) | (a != a[lead])
            for i in range(0, len(h), 100_000):
                j = slice(i, i + 100_000)
                use = again[j] | head[j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[j][use], t) for v, t in ((doc, pa.int64()), (key, pa.int64()), (a, pa.int32()),
                                                         (b, pa.int32()), (h, pa.int64()), (again, pa.bool_()))],
                    names=["doc_id", "text_key", "first", "last", "hash", "repeat"])
    return run


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, first, last): runs that are not the first of their
    hash, as sentence numbers [first, last)."""
    s = Scratch(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    found = s.keep(keyed.mapInArrow(_spans(min_words), RUNS), "runs")
    place = F.struct("doc_id", "text_key", "first")
    among = (found.where("not repeat")
             .withColumn("lead", F.min(place).over(W.partitionBy("hash")))
             .where(place != F.col("lead")))
    cols = ("doc_id", "text_key", "first", "last")
    out = s.keep(among.select(*cols).union(found.where("repeat").select(*cols)).distinct(), "spans")
    s.drop(found)
    return out


def _cut(batches):
    for batch in batches:
        buf_all, off_all = ta.utf8(batch.column(1))
        valid = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        cuts = batch.column(2)
        texts, spans, total, gone = [], [], [], []
        for x, y in ta.slices(off_all):
            off = off_all[x:y + 1] - off_all[x]
            buf = buf_all[off_all[x]:off_all[y]]
            w, first_word, first_sentence = sentences(buf, off)
            for i in range(y - x):
                lo, hi = first_sentence[i], first_sentence[i + 1]
                total.append(int(hi - lo))
                raw = buf[off[i]:off[i + 1]]
                cut = cuts[x + i].as_py()
                if not cut:
                    gone.append(0)
                    spans.append("")
                    texts.append(raw.tobytes().decode() if valid[x + i] else None)
                    continue
                drop = np.zeros(hi - lo + 1, np.int64)
                for c in cut:
                    drop[c["first"]] += 1
                    drop[c["last"]] -= 1
                drop = np.cumsum(drop)[:-1] > 0
                gone.append(int(drop.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], drop, [0]])))
                starts, ends = edge[::2] + lo, edge[1::2] + lo
                # a region: from the end of the word before it to its own last word's end
                s = np.where(starts > lo, w.end[np.maximum(first_word[starts] - 1, 0)], off[i]) - off[i]
                e = w.end[first_word[ends] - 1] - off[i]
                cp = ta.code_points(raw)
                spans.append(",".join(f"{cp[p]}:{cp[q]}" for p, q in zip(s, e)))
                keep = np.zeros(len(raw) + 1, np.int64)
                np.add.at(keep, s, 1)
                np.add.at(keep, e, -1)
                left = raw[np.cumsum(keep)[:-1] == 0].tobytes().decode()
                texts.append(left.lstrip(" \t\n\r\v\f") if drop[0] else left)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
             pa.array(spans, pa.string())], names=["doc_id", "text", "n_sentences", "n_removed", "removed_spans"])


def dedup_sentence_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text without repeated spans,
    n_sentences, n_removed (sentences), removed_spans (start:end code points
    of the original text, joined by commas)."""
    spans = repeated_spans(docs, min_words)
    cuts = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("cuts"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    joined = keyed.join(cuts, ["doc_id", "text_key"], "left").select(F.col("doc_id").cast("long"), "text", "cuts")
    return joined.mapInArrow(_cut, "doc_id long, text string, n_sentences long, n_removed long, removed_spans string")
