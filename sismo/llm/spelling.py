"""Spelling variants by Bloom-guided neighbourhoods (operator 13).

Words of a corpus that differ by one inserted, deleted or replaced code point
are near; a word's form is its near word of largest count, if that is FACTOR
times as frequent, and forms are followed to a root.

* Words: runs of letters, counted per slice, then by one aggregate. In
  one of ``DROP_EVERY`` (document, run) pairs, chosen by CRC-32, one code point
  is deleted; the CRCs of all pairs of a slice advance together, byte by byte.
* Filters: the vocabulary is split by length (code points). Tasks set the bits
  of its words in blocked Bloom filters (one 64-bit block a word, PROBES bits
  in it); the blocks are merged by a bitwise aggregate.
* Probing: the filters are broadcast. A word's edits are not written out: the
  hash of each replacement and deletion follows from the word's own hash, and
  whole arrays of hashes are probed in the filter of their length. Replacements
  go to larger code points only and insertions are the deletions of the other
  word, so every near pair is found once.
* Exact join: only positives become strings; they are shuffled to a join with
  the vocabulary that drops the filters' false positives.

The broadcast is bounded by ``FILTER_BYTES``: a vocabulary that would need more
at ``BITS`` a word is dealt by hash to several rounds, each with filters of that
size, and a round probes only the edits of its own share. Memory of a task is
bounded by ``BLOCK`` hashes.

Defined results: null text holds no words; a null doc_id counts as the empty
string in the CRC; repeated rows count like any others; ties of a form go to
the smallest word in code-point order; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from . import textarr as ta
from .divergence import gathered

SHORTEST, AT_LEAST, FACTOR, DROP_EVERY = 6, 5, 5, 199
BITS, PROBES = 16, 4
FILTER_BYTES = 32 << 20
BLOCK = 1 << 18
U64 = np.uint64

_ASCII = np.zeros(256, bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and one more
_OUTSIDE = ~_ASCII
_OUTSIDE[0x80:] = False
#: Code points a word can hold; capitals A-Z are lower-cased.
ALPHABET = np.concatenate([np.arange(0x61, 0x7B), np.arange(0xC0, 0x100)])


# ---- words ----------------------------------------------------------------

def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()
_STEPS = 64  # bytes that advance together; longer runs go on one by one


def crc_after(state: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """zlib.crc32 of each buf[start:end] continued from ``state``."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    c, s, size = state[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF), start[order], size[order]
    for j in range(min(_STEPS, int(size[0]) if len(size) else 0)):
        n = int(np.searchsorted(-size, -j))  # runs longer than j
        c[:n] = _CRC[(c[:n] ^ buf[s[:n] + j]) & np.uint32(0xFF)] ^ (c[:n] >> np.uint32(8))
    c ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _STEPS):
        c[i] = zlib.crc32(buf[s[i] + _STEPS:s[i] + size[i]].tobytes(), int(c[i]))
    out = np.empty_like(c)
    out[order] = c
    return out


def letters(buf: np.ndarray) -> np.ndarray:
    """The text with A-Z lower-cased and all that is no letter as a space."""
    lead = buf == _LEAD
    inside = _ASCII[buf] | lead
    inside[1:] |= lead[:-1]
    low = buf + (_UPPER[buf] * np.uint8(32)).astype(np.uint8)
    return np.where(inside, low, np.uint8(0x20))


def _slice_words(buf, off, ids) -> pa.RecordBatch:
    """Words and their occurrences in one slice. ids: bytes before each
    document's runs in the CRC."""
    low = letters(buf)
    w = ta.words(low, off, _OUTSIDE)
    doc = np.searchsorted(w.first, np.arange(len(w.start)), side="right") - 1
    cp = ta.code_points(low)
    size = cp[w.end] - cp[w.start]
    at = np.flatnonzero(size >= SHORTEST)
    start, end, doc, size = w.start[at], w.end[at], doc[at], size[at]
    enc = gathered(low, start, end).dictionary_encode()
    code, n = enc.indices.to_numpy().astype(np.int64), max(1, len(enc.dictionary))
    pair, first, times = np.unique(doc * n + code, return_index=True, return_counts=True)
    prefix = np.array([zlib.crc32(b) for b in ids], np.uint32)
    h = crc_after(prefix[doc[first]], low, start[first], end[first])
    cut = h % DROP_EVERY == 0
    total = np.bincount(pair[~cut] % n, times[~cut], n).astype(np.int64)
    more = []
    for i in np.flatnonzero(cut):
        run = low[start[first[i]]:end[first[i]]].tobytes().decode()
        k = int(h[i]) % len(run)
        more.append(run[:k] + run[k + 1:])
    keep = [i for i, m in enumerate(more) if len(m) >= SHORTEST]
    some = np.flatnonzero(total)
    words = pa.concat_arrays([enc.dictionary.take(pa.array(some)), pa.array([more[i] for i in keep], pa.large_string())])
    count = np.concatenate([total[some], times[cut][keep]]).astype(np.int64)
    return pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(count)], names=["word", "n"])


def _words(batches):
    for batch in batches:
        ids = [b"%d:" % i if i is not None else b":" for i in batch.column(0).to_pylist()]
        buf_all, off_all = ta.utf8(batch.column(1))
        for p, q in ta.slices(off_all):
            yield _slice_words(buf_all[off_all[p]:off_all[q]], off_all[p:q + 1] - off_all[p], ids[p:q])


def vocabulary(docs: DataFrame, at_least: int = AT_LEAST) -> DataFrame:
    """word, n: results of at least SHORTEST code points and ``at_least``
    occurrences."""
    return (docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_words, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least))


# ---- Bloom filters ----------------------------------------------------------

def matrices(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Words by length: (rows, code points as rows x length)."""
    data = column.to_pylist()
    size = np.array([len(w) for w in data], np.int64)
    out = {}
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        flat = np.frombuffer("".join(data[i] for i in rows).encode("utf-32-le"), np.uint32)
        out[int(n)] = rows, flat.reshape(len(rows), int(n)).astype(U64)
    return out


def raw_hash(points: np.ndarray) -> np.ndarray:
    """Polynomial hash of each row; ``ta.mix`` makes the final one of it."""
    pw = ta.powers(points.shape[1] + 1)[0]
    with np.errstate(over="ignore"):
        return (points * pw[:points.shape[1]]).sum(axis=1, dtype=U64)


@dataclass
class Filters:
    """Blocks of one round by word length, and how many rounds there are."""
    blocks: dict[int, np.ndarray]
    rounds: int
    turn: int

    def has(self, length: int, raw: np.ndarray) -> np.ndarray:
        f = self.blocks.get(length)
        if f is None:
            return np.zeros(raw.shape, bool)
        h = ta.mix(raw)
        bits = bits_of(h)
        hit = (f[block_of(h, len(f))] & bits) == bits
        return hit & (round_of(h, self.rounds) == self.turn) if self.rounds > 1 else hit


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """By the high 32 bits, in proportion."""
    return ((h >> U64(32)) * U64(blocks)) >> U64(32)


def bits_of(h: np.ndarray) -> np.ndarray:
    """PROBES bits of a 64-bit block, by the low 24 bits."""
    out = np.zeros(h.shape, U64)
    for i in range(PROBES):
        out |= U64(1) << ((h >> U64(6 * i)) & U64(63))
    return out


def round_of(h: np.ndarray, rounds: int) -> np.ndarray:
    return (ta.mix(h) % U64(rounds)).astype(np.int64)


def build_filters(vocab: DataFrame, sizes: dict[int, int], rounds: int, turn: int) -> Filters:
    """Filters of one round. sizes: words by length. The tasks' blocks are
    merged by ``bit_or``; what comes back is bounded by FILTER_BYTES."""
    n_blocks = {n: max(1, -(-words * BITS // (64 * rounds))) for n, words in sizes.items()}

    def run(batches):
        for batch in batches:
            for n, (_, points) in matrices(batch.column(0)).items():
                h = ta.mix(raw_hash(points))
                if rounds > 1:
                    h = h[round_of(h, rounds) == turn]
                at, back = np.unique(block_of(h, n_blocks[n]).astype(np.int64), return_inverse=True)
                bits = np.zeros(len(at), U64)
                np.bitwise_or.at(bits, back, bits_of(h))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n), pa.int32()), pa.array(at), pa.array(bits.view(np.int64))],
                                                 names=["length", "block", "bits"])
    merged = (vocab.select("word").mapInArrow(run, "length int, block long, bits long")
              .groupBy("length", "block").agg(F.bit_or("bits").alias("bits")).toArrow())
    out = {n: np.zeros(k, U64) for n, k in n_blocks.items()}
    length, block = merged["length"].to_numpy(), merged["block"].to_numpy()
    bits = merged["bits"].to_numpy().view(U64)
    for n in out:
        mine = length == n
        out[n][block[mine]] = bits[mine]
    return Filters(out, rounds, turn)


def positives(points: np.ndarray, filters: Filters):
    """(row, place, code point or 0 for a deletion) of every edit of the rows
    that the filters let through. Replacements go to larger code points."""
    m, n = points.shape
    pw, inverse = (p[:n + 1] for p in ta.powers(n + 1))
    letter = ALPHABET.astype(U64)
    rows, places, codes = [], [], []
    with np.errstate(over="ignore"):
        if n in filters.blocks:
            step = max(1, BLOCK // len(letter))
            base = raw_hash(points)
            for p in range(0, m * n, step):  # (row, place) pairs in order
                pair = np.arange(p, min(p + step, m * n))
                r, i = pair // n, pair % n
                own = points[r, i]
                raw = (base[r] - own * pw[i])[:, None] + letter[None, :] * pw[i][:, None]
                hit = filters.has(n, raw) & (letter[None, :] > own[:, None])
                a, b = np.nonzero(hit)
                rows.append(r[a])
                places.append(i[a])
                codes.append(ALPHABET[b])
        if n - 1 in filters.blocks:
            step = max(1, BLOCK // n)
            for p in range(0, m, step):
                part = points[p:p + step]
                terms = part * pw[:n]
                before = np.cumsum(terms, axis=1, dtype=U64) - terms
                after = (terms.sum(axis=1, dtype=U64)[:, None] - before - terms) * inverse[1]
                hit = filters.has(n - 1, before + after)
                hit[:, 1:] &= part[:, 1:] != part[:, :-1]  # of equal neighbours the first
                a, b = np.nonzero(hit)
                rows.append(a + p)
                places.append(b)
                codes.append(np.zeros(len(a), np.int64))
    z = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else z for x in (rows, places, codes))


def guesses(vocab: DataFrame, filters) -> DataFrame:
    """word, n, edit: edits of vocabulary words that pass a round's filters
    (a broadcast)."""
    def run(batches):
        f = filters.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            count = batch.column(1)
            for rows, points in matrices(batch.column(0)).values():
                r, place, code = positives(points, f)
                r = rows[r]
                edit = [(w := words[i])[:k] + (chr(c) if c else "") + w[k + 1:] for i, k, c in zip(r.tolist(), place.tolist(), code.tolist())]
                at = pa.array(r, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), count.take(at), pa.array(edit, pa.string())], names=["word", "n", "edit"])
    return vocab.select("word", "n").mapInArrow(run, "word string, n long, edit string")


def near_pairs(vocab: DataFrame) -> DataFrame:
    """word, n, other, other_n of all near pairs, in both directions. ``vocab``
    should be a written table: it is read several times."""
    spark = vocab.sparkSession
    sizes = {r.size: r.words for r in vocab.groupBy(F.length("word").alias("size")).agg(F.count(F.lit(1)).alias("words")).collect()}  # a row per length
    rounds = max(1, -(-sum(sizes.values()) * BITS // (8 * FILTER_BYTES)))
    own = vocab.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    found = []
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(build_filters(vocab, sizes, rounds, turn))  # at most FILTER_BYTES
        found.append(guesses(vocab, shared).join(own, "edit"))
    out = reduce(DataFrame.union, found)
    both = F.array(F.struct("word", "n", F.col("edit").alias("other"), F.col("edit_n").alias("other_n")),
                   F.struct(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return out.select(F.explode(both).alias("x")).select("x.*")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word. Runs jobs when
    called; the last links are followed in a number of joins that is
    logarithmic in the longest chain (counts rise by FACTOR a link)."""
    s = Scratch(docs.sparkSession)
    vocab = s.keep(vocabulary(docs), "vocabulary")
    best = F.max_by(F.struct("other", "other_n"), F.struct("other_n", "rank"))
    # of equal counts the smallest word: max_by over its bytes turned round
    pairs = near_pairs(vocab).withColumn("rank", F.translate(F.hex("other"), "0123456789ABCDEF", "FEDCBA9876543210"))
    pairs = pairs.withColumn("rank", F.concat("rank", F.lit("G")))  # a prefix stands before its longer words
    form = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = vocab.join(form, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        *[F.when(F.col("best.other_n") >= FACTOR * F.col("n"), F.col(f"best.{c}")).alias(a) for c, a in (("other", "form"), ("other_n", "form_n"))])
    rows = s.keep(rows, "forms")
    link = s.keep(rows.where("form is not null").select("word", F.col("form").alias("up")), "links")
    while True:  # every pass doubles the length of the links followed
        top = link.select(F.col("word").alias("up"), F.col("up").alias("next"))
        far = s.keep(link.join(top, "up", "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("more")), "links")
        s.drop(link)
        link = far
        if link.where("more").isEmpty():
            break
    s.drop(vocab)
    return (rows.join(link.select("word", F.col("up").alias("root")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def oracle() -> str:
    """The same rows in DuckDB: CRC-32 bit by bit over every run's bytes, near
    pairs by equal deletions."""
    points = "list_transform(list_filter(string_split({}, ''), lambda c: c <> ''), lambda c: unicode(c))"
    utf8 = f"flatten(list_transform({points.format('run')}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [195, u - 64] END))"
    head = "list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':', ''), lambda c: unicode(c))"
    steps = f"flatten(list_transform(list_concat({head}, {utf8}), lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))"
    x = "xor(s, b)"
    crc = f"xor(list_reduce(list_concat([4294967295::bigint], list_transform({steps}, lambda b: b::bigint)), lambda s, b: xor({x} >> 1, 3988292384 * ({x} & 1))), 4294967295)"
    return f"""
with recursive o as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[A-Za-zÀ-ÿ]+')) as run from documents),
r as (select doc_id, run, count(*) as times from o where length(run) >= {SHORTEST} group by 1, 2),
h as (select run, times, {crc} as h from r),
w as (select case when h % {DROP_EVERY} = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, times from h),
v as (select word, cast(sum(times) as bigint) as n from w where length(word) >= {SHORTEST} group by 1 having sum(times) >= {AT_LEAST}),
d as (select word, n, unnest(range(1, length(word) + 1)) as i from v),
e as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as cut from d),
p as (select a.word, b.word as other, b.n as other_n from e a join e b on a.cut = b.cut and a.i = b.i and a.word <> b.word
      union select e.word, v.word, v.n from e join v on v.word = e.cut
      union select v.word, e.word, e.n from e join v on v.word = e.cut),
f as (select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from p group by 1),
t as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when other_n >= {FACTOR} * n then other end as form,
        case when other_n >= {FACTOR} * n then other_n end as form_n from v left join f using (word)),
c as (select word, word as root from t where form is null
      union all select t.word, c.root from t join c on t.form = c.word)
select word, form, root, n, n_near, form_n from t join c using (word)"""
