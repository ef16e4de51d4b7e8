"""Hierarchical residual packing of token sequences (operator 4).

Documents become pieces of at most ``CAPACITY`` ids; pieces go into sequences
of that capacity, as few as possible. Each partition packs its pieces best
fit, longest first, and emits the bins that are nearly full. The underfull
ones become items of the next round, on fewer partitions, and so on up the
tree until one task holds the rest: an item there is a bin of the round
before, with its members inside.

A task packs at most ``CHUNK`` items at a time, so memory is bounded in every
round; a round that no longer lowers the number of open bins ends the tree
(then no merging can). Every round is a table in the shared scratch folder.

Defined results: a null or empty text is one piece of the end id; repeated
rows are packed each for itself (same doc_id and piece numbers); a null
doc_id stays null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from . import textarr as ta
from .tokens import tokenizer, with_end

CAPACITY = 4096
END_ID = 1
CHUNK = 200_000
NEARLY_FULL = 4080
FAN_IN = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BINS = ("sequence_id long, fill int, closed boolean, "
        "members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document with the checksum of their ids."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            buf, off = ta.utf8(batch.column(1))
            for a, b in ta.slices(off):
                flat, first = with_end(*tokenizer(path).encode(buf[off[a]:off[b]], off[a:b + 1] - off[a]), end_id)
                size = np.diff(first)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                raw = memoryview(flat.astype("<u4")).cast("B")
                at = (first[:-1][doc] + start) * 4
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(at.tolist(), (at + length * 4).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of every item: longest first, each into the fullest bin
    that still holds it. Ties go by position, so a retry repeats it."""
    bin_of = np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by room left
    open_rooms = n = 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = open_rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_rooms ^= 1 << room
        else:
            room, b = capacity, n
            n += 1
        bin_of[i] = b
        room -= size
        if room:
            free[room].append(b)
            open_rooms |= 1 << room
    return bin_of


def _merge(capacity, nearly_full, chunk, level, last):
    """Items (fill, members) -> bins, ``chunk`` items at a time."""
    def pack(items, part, number):
        t = pa.Table.from_batches(items).combine_chunks()
        lists = t.column("members").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        fill = t.column("fill").to_numpy().astype(np.int64)
        off = lists.offsets.to_numpy().astype(np.int64)
        bin_of = best_fit(fill, capacity)
        order = np.argsort(bin_of, kind="stable")
        n_bins = int(bin_of.max()) + 1
        bin_fill = np.bincount(bin_of, weights=fill, minlength=n_bins).astype(np.int64)
        # members in bin order; an item's members move behind the items before it
        ends = np.cumsum(fill[order])
        bin_end = np.cumsum(bin_fill)
        base = ends - fill[order] - (bin_end - bin_fill)[bin_of[order]]
        size = np.diff(off)[order]
        at = np.repeat(off[:-1][order] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        m = lists.values.take(pa.array(at))
        cols = [m.field(i) for i in range(5)] + [pa.array(m.field(5).to_numpy() + np.repeat(base, size))]
        n_members = np.bincount(bin_of[order], weights=size, minlength=n_bins).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(n_members)])
        members = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(cols, fields=list(_MEMBER)))
        seq = (level << 56) + (part << 28) + number + np.arange(n_bins)
        closed = np.ones(n_bins, bool) if last else bin_fill >= nearly_full
        whole = pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(bin_fill, pa.int32()), pa.array(closed), members],
                                           names=["sequence_id", "fill", "closed", "members"])
        return n_bins, whole

    def run(batches):
        from pyspark import TaskContext
        part, number, held, rows = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for a in range(0, len(batch), chunk):
                x = batch.slice(a, chunk)
                if rows + len(x) > chunk:
                    n, out = pack(held, part, number)
                    number, held, rows = number + n, [], 0
                    yield out
                held.append(x)
                rows += len(x)
        if rows:
            yield pack(held, part, number)[1]
    return run


def pack(items: DataFrame, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL, chunk: int = CHUNK,
         fan_in: int = FAN_IN) -> DataFrame:
    """``items`` (PIECES) with sequence_id and offset."""
    s = Scratch(items.sparkSession)
    whole = F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset")))
    todo = items.select(F.col("length").cast("int").alias("fill"), whole.alias("members"))
    before, done, level, parts = None, [], 0, 0
    while True:
        last = parts == 1
        bins = s.keep(todo.mapInArrow(_merge(capacity, nearly_full, chunk, level, last), BINS), "bins")
        done.append(bins.where("closed"))
        left = bins.where("not closed")
        n, top = left.agg(F.count(F.lit(1)), F.max(F.expr("shiftright(sequence_id, 28) & 268435455"))).first()
        if n == 0:
            break
        if before is not None and n > chunk and n >= 0.99 * before:  # no merge can help any more
            done[-1] = bins
            break
        parts = max(-(-n // chunk), -(-(top + 1) // fan_in))
        before, level = n, level + 1
        todo = left.select("fill", "members").repartition(parts)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("sequence_id", F.inline("members")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack whole documents: one row per piece with doc_id,
    piece, start, length, ids_crc32, sequence_id, offset."""
    s = Scratch(docs.sparkSession)
    return pack(s.keep(pieces(docs, path, capacity, end_id), "pieces"), capacity)
