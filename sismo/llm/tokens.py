"""Token ids of whole documents from a public tokenizer file.

Both tokenizers used here cut a text before they merge, and always cut
between a non-space character and an ASCII white space. So a text's ids are
the ids of its words (each with the white space before it) joined. The words
of a slice are made distinct by 64-bit hashes, only new ones go to the
library, and numpy joins the ids. Texts with other Unicode white space, where
that rule could fail, go to the library whole, and so do texts that hold the
mark of an added token (such as ``<|endoftext|>``): like the library's own
``encode`` they get that token's id there.
"""

from __future__ import annotations

import os
import re

import numpy as np

from . import textarr as ta

CACHED_WORDS = 2_000_000
PER_CALL = 128
SPACES = " \t\n\r\v\f"
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: letters of Latin-1 and at most one run of marks after them: one or two pieces
SIMPLE = re.compile(r"[ \t\n\r\v\f]*[A-Za-zÀ-ÖØ-öø-ÿ]+([.,;:!?*#$%&|-]*)$")
# First UTF-8 bytes (and second ones) that such white space can begin with.
_LEAD = {0xC2: (0x85, 0xA0), 0xE1: (0x9A,), 0xE2: (0x80, 0x81), 0xE3: (0x80,)}


def _odd_bytes(buf: np.ndarray) -> np.ndarray:
    """Positions where other white space may stand (a superset)."""
    hit = (buf >= 0x1C) & (buf <= 0x1F)
    if len(buf) > 1:
        for lead, seconds in _LEAD.items():
            hit[:-1] |= (buf[:-1] == lead) & np.isin(buf[1:], seconds)
    return np.flatnonzero(hit)


class WordTokenizer:
    """Encodes slices of documents; keeps the ids of words seen lately."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True  # words are plain text; whole texts with a mark are not
        #: marks of added tokens, lower-cased since a normalizer may do so first
        self.marks = sorted({t.content.lower().encode() for t in self.lib.get_added_tokens_decoder().values()})
        self.lib.model._resize_cache(0)  # words come here once, so the library's own cache only costs
        split, suffix = self.lib.pre_tokenizer, self.lib.model.end_of_word_suffix
        vocab = self.lib.get_vocab(with_added_tokens=False)
        #: bytes of each id, when a text's tokens are exactly its bytes
        self.sizes = None
        if self.lib.normalizer is None and isinstance(split, ByteLevel) and not split.add_prefix_space:
            self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
            self.sizes[list(vocab.values())] = [len(t) for t in vocab]
        #: ids that end a piece, when the merges mark the ends of pieces
        self.ends = None
        if suffix:
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[list(vocab.values())] = [t.endswith(suffix) for t in vocab]
        self._forget()

    def _forget(self):
        self.known = np.zeros(0, np.uint64)   # hashes of known words, sorted
        self.place = np.zeros(0, np.int32)    # their rows in the arrays below
        self.begin, self.size = np.zeros((2, 0), np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _split_ids(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the words in some order, that order, ids of each word)."""
        count = np.zeros(len(new), np.int64)
        parts = [None] * len(new)
        joined = [i for i, w in enumerate(new) if self.sizes is not None and w[0] in SPACES and w[-1] not in SPACES]
        for call, e in self._calls(joined, new, lambda c: self.lib.encode_batch_fast(["".join(w) for w in c], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)  # joined words are cut where they were joined
            last = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(new[i].encode()) for i in call])) + 1
            count[call] = np.diff(last, prepend=0)
            parts[call[0]] = ids
        simple = [m and 1 + bool(m[1]) for m in map(SIMPLE.match, new)] if self.ends is not None else []
        spaced = [i for i, n in enumerate(simple) if n]
        for call, e in self._calls(spaced, new, lambda c: self.lib.encode_batch_fast([" ".join(w) for w in c], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)  # pieces end where their ids say so
            piece_ends = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum([simple[i] for i in call])
            if len(piece_ends) == last[-1] and piece_ends[-1] == len(ids):
                count[call] = np.diff(piece_ends[last - 1], prepend=0)
                parts[call[0]] = ids
        joined += [i for i in spaced if count[i]]
        alone = [i for i in range(len(new)) if count[i] == 0]
        for call, e in self._calls(alone, new, lambda c: self.lib.encode_batch(c, is_pretokenized=True, add_special_tokens=False)):
            count[call] = np.bincount(np.array(e.word_ids, np.int64), minlength=len(call))
            parts[call[0]] = np.array(e.ids, np.uint32)
        order = np.array(joined + alone, np.int64)
        ids = np.concatenate([parts[i] for i in order if parts[i] is not None])
        return ids, order, count

    @staticmethod
    def _calls(numbers, new, encode):
        calls = [numbers[i:i + PER_CALL] for i in range(0, len(numbers), PER_CALL)]
        return zip(calls, encode([[new[i] for i in c] for c in calls])) if calls else ()

    def _learn(self, new: list[str], hashes: np.ndarray) -> None:
        ids, order, count = self._split_ids(new)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) // 4 + len(ids), np.uint32)])
        self.flat[self.used:self.used + len(ids)] = ids
        begin = np.empty(len(new), np.int32)
        begin[order] = self.used + np.cumsum(count[order]) - count[order]
        self.used += len(ids)
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.place = np.insert(self.place, at, len(self.begin) + np.arange(len(new), dtype=np.int32))
        self.begin = np.concatenate([self.begin, begin])
        self.size = np.concatenate([self.size, count.astype(np.int32)])

    def _rows(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows of the words buf[bounds[i]:bounds[i + 1]]; learns new ones."""
        distinct, one, which = np.unique(ta.spans_hash(buf, bounds[:-1], bounds[1:]), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        found = np.zeros(len(distinct), bool)
        if len(self.known):
            found = self.known[np.minimum(at, len(self.known) - 1)] == distinct
        if len(missing := np.flatnonzero(~found)):
            raw = memoryview(np.ascontiguousarray(buf))
            spans = zip(bounds[one[missing]].tolist(), bounds[one[missing] + 1].tolist())
            self._learn([str(raw[a:b], "utf-8") for a, b in spans], distinct[missing])
            at = np.searchsorted(self.known, distinct)
        return self.place[at][which]

    def _marked(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Documents that may hold the mark of an added token."""
        out = np.zeros(len(off) - 1, bool)
        low = buf.tobytes().lower()
        for mark in self.marks:
            at = low.find(mark)
            while at >= 0:
                d = int(np.searchsorted(off, at, side="right")) - 1
                out[d] = True
                at = low.find(mark, int(off[d + 1]))
        return out

    def _whole(self, text: str) -> np.ndarray:
        self.lib.encode_special_tokens = False
        try:
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)
        finally:
            self.lib.encode_special_tokens = True

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, offsets of each document's ids)."""
        n_docs = len(off) - 1
        odd = np.zeros(n_docs, bool)
        if len(at := _odd_bytes(buf)):
            for d in np.unique(np.searchsorted(off, at, side="right") - 1):
                odd[d] = bool(ODD_SPACE.search(buf[off[d]:off[d + 1]].tobytes().decode()))
        odd |= self._marked(buf, off)
        if len(self.known) > CACHED_WORDS:
            self._forget()
        space = ta.IS_SPACE[buf]
        cut = np.zeros(len(buf) + 1, bool)
        cut[off] = True
        cut[1:-1] |= space[1:] & ~space[:-1]
        bounds = np.flatnonzero(cut)
        which = self._rows(buf, bounds) if len(bounds) > 1 else np.zeros(0, np.int32)
        size = self.size[which].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.arange(total) + np.repeat(self.begin[which] - (ends - size), size)]
        doc_word = np.searchsorted(bounds, off)
        doc_word[-1] = len(bounds) - 1
        first = np.concatenate([[0], ends])[doc_word]
        if odd.any():
            parts, at = [], 0
            for d in np.flatnonzero(odd):
                parts.append(flat[first[at]:first[d]])
                parts.append(self._whole(buf[off[d]:off[d + 1]].tobytes().decode()))
                at = d + 1
            parts.append(flat[first[at]:])
            count = np.diff(first)
            count[odd] = [len(p) for p in parts[1::2]]
            flat, first = np.concatenate(parts), np.concatenate([[0], np.cumsum(count)])
        return flat, first


_KEPT: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file; one file is kept at a time."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = WordTokenizer(path)
    return _KEPT[path]


def release() -> None:
    """Free the worker's tokenizer: later stages reuse the worker."""
    _KEPT.clear()
    ta.give_back()


def with_end(flat: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every document's ids followed by ``end_id``."""
    n = len(first) - 1
    out = np.full(len(flat) + n, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    last = first[1:] + np.arange(n)
    keep[last] = False
    out[keep] = flat
    return out, first + np.arange(n + 1)
