"""Text of an Arrow batch as numpy arrays: bytes, words, hashes.

All helpers work on the UTF-8 bytes of many documents at once, so a batch
costs a few numpy passes rather than a Python step per word. ``slices`` cuts
a batch into pieces of bounded size (always whole documents) and ``words``
goes through the bytes in blocks, so temporaries stay small even when one
document is very long.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError):  # another C library: nothing to trim
    _LIBC = None
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
BLOCK = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def give_back() -> None:
    """Return freed memory to the system. The C library keeps it for later
    otherwise, and a Python worker shares its executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.empty(n, U64)
    p[0] = 1
    with np.errstate(over="ignore"):
        p[1:] = U64(base)
        np.multiply.accumulate(p, out=p)
    return p


_POW = [_powers(_MULT, BLOCK + 1), _powers(_INV, BLOCK + 1)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if n > len(_POW[0]):
        size = max(n, 2 * len(_POW[0]))
        if size > 8 * BLOCK:
            return _powers(_MULT, n), _powers(_INV, n)
        _POW[:] = [_powers(_MULT, size), _powers(_INV, size)]
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each values[start:end], equal for equal contents
    wherever they stand. values: unsigned integers; segments may overlap."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    pw, ip = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(values) + 1, U64)
        np.cumsum((values.astype(U64) + U64(1)) * pw[:len(values)], out=run[1:])
        h = (run[ends] - run[starts]) * ip[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def spans_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``segment_hash`` of ascending spans that do not overlap, in blocks of
    bounded size."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, side="right")))
        lo, hi = start[i], end[j - 1]
        out[i:j] = segment_hash(buf[lo:hi], start[i:j] - lo, end[i:j] - lo)
        i = j
    return out


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not large and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    bufs = column.buffers()
    n = len(column)
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if large else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0]:off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Document ranges [a, b) of at most ``most`` bytes, or one document.
    After the last one, freed memory goes back to the system."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b
    give_back()


@dataclass
class Words:
    """Words of consecutive documents: byte spans, hashes, and for document d
    the words first[d]:first[d + 1]."""
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(buf: np.ndarray, off: np.ndarray, separator: np.ndarray = IS_SPACE) -> Words:
    """Maximal runs of bytes that are no separators; ``off`` starts at 0 and
    words never cross documents. Bytes from 0x80 on belong to whole code
    points and must share one class."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(0, U64), np.zeros(len(off), np.int64))
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    inside = ~separator[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    finish = inside
    finish[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(finish) + 1
    del begins, finish, inside
    return Words(start, end, spans_hash(buf, start, end), np.searchsorted(start, off))


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``size`` items inside each group
    first[d]:first[d + 1], and each window's group."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    group = np.repeat(np.arange(len(count)), count)
    base = np.cumsum(count) - count
    return np.arange(len(group)) - base[group] + first[:-1][group], group


def code_points(buf: np.ndarray) -> np.ndarray:
    """Code points before each byte position (length + 1 entries)."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def counts(values: np.ndarray, group_starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive groups (length + 1 bounds)."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return np.diff(run[group_starts])
