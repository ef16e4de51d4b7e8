"""Token ids in files of canonical, length-limited Huffman code (operator 5).

Format (a folder): ``codes`` holds one row per id that occurs, (id, length),
and the code is the canonical one of these lengths; ``segments`` holds the
streams, its files in ascending doc_id order. A segment is a run of whole
documents: shard and first_id (its place: the shard's number and the ids of
the shard before it), doc_ids and sizes (64-bit little-endian arrays),
payload (the code bits, most significant first, padded with zero bits) and
checkpoints (64-bit bit offsets of every ``BLOCK``-th id), from which blocks
decode independently: all blocks of a segment advance together, one table
lookup per id.

Writing: one Arrow pass tokenises into a compressed scratch table, ids are
counted globally (partial sums, one row per id), the code is made on the
driver from at most one row per vocabulary entry, then documents are range
partitioned and sorted by doc_id and encoded. Reading is map-only but for the
shard sums, one row per shard.

Defined results: a null or empty text is just the end id; rows with null
doc_id come first; repeated rows are stored each for itself; an empty table
gives an empty folder and an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Scratch, scratch_path
from . import textarr as ta
from .tokens import release, tokenizer, with_end

END_ID = 2
MAX_LENGTH = 20
BLOCK = 512
SEGMENT = 1 << 18  # ids a segment has at most, but for a single longer document

SEGMENTS = ("shard int, first_id long, n_ids long, doc_ids binary, known binary, sizes binary, "
            "payload binary, checkpoints binary")


# ---- code -------------------------------------------------------------

def code_lengths(counts: np.ndarray, most: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits (0: the id is absent),
    by package-merge: the 2n - 2 cheapest items of the last list, each
    counting the symbols inside it."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 1:
        out[used] = 1
    if n < 2:
        return out
    if n > 1 << most or most > 31 or len(counts) > 1 << 27:
        raise ValueError("the length limit is too small for this many ids, or the table too narrow for them")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.float64)
    levels = []  # for each list, which of its sorted items are packages
    items = weight
    for _ in range(most - 1):
        pairs = items[:len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        levels.append(order >= n)
        items = both[order]
    length = np.zeros(n, np.int64)
    take = 2 * n - 2
    for package in reversed(levels):
        inside = int(package[:take].sum())
        length[:take - inside] += 1  # the cheapest symbols, in order
        take = 2 * inside
    length[:take] += 1
    out[used] = length
    return out


def canonical(length: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    code = np.zeros(len(length), np.uint64)
    order = np.lexsort((np.arange(len(length)), length))
    order = order[length[order] > 0]
    value = before = 0
    for bits in range(1, int(length.max(initial=0)) + 1):
        ids = order[length[order] == bits]
        value <<= bits - before
        code[ids] = value + np.arange(len(ids), dtype=np.uint64)
        value, before = value + len(ids), bits
    return code


def encode_bits(ids, code, length):
    """(bytes, bit offset of every id and of the end)."""
    size = length[ids].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    words = np.zeros((int(at[-1]) >> 6) + 2, np.uint64)
    if len(ids):
        c, pos = code[ids], at[:-1]
        word, room = pos >> 6, 64 - (pos & 63) - size
        fits = room >= 0
        part = np.where(fits, c << np.maximum(room, 0).astype(np.uint64), c >> np.maximum(-room, 0).astype(np.uint64))
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[start]] = np.bitwise_or.reduceat(part, start)
        over = np.flatnonzero(~fits)
        words[word[over] + 1] |= c[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[:(int(at[-1]) + 7) // 8], at


class Decoder:
    """Lookup table over the next ``bits`` bits: id and, in the low five
    bits, code length."""

    def __init__(self, length: np.ndarray):
        self.bits = int(length.max(initial=1))
        order = np.lexsort((np.arange(len(length)), length))
        order = order[length[order] > 0]
        span = (1 << (self.bits - length[order].astype(np.int64)))
        self.table = np.ones(1 << self.bits, np.uint32)
        self.table[:span.sum()] = np.repeat((order << 5 | length[order]).astype(np.uint32), span)

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        """All ``n`` ids; block b starts at bit checkpoints[b]."""
        raw = np.frombuffer(payload + b"\0" * (16 - len(payload) % 4), ">u4").astype(np.uint64)
        wide = (raw[:-1] << np.uint64(32)) | raw[1:]
        out = np.zeros((block, len(checkpoints)), np.uint32)
        pos = checkpoints.astype(np.uint64)
        full, rest = divmod(n, block)
        shift, mask = np.uint64(64 - self.bits), np.uint64((1 << self.bits) - 1)
        five, low = np.uint64(5), np.uint64(31)
        for i in range(block):
            m = full + (i < rest)  # the last block may be shorter
            if m == 0:
                break
            p = pos[:m]
            found = self.table[(wide[p >> five] >> (shift - (p & low))) & mask]
            out[i, :m] = found
            p += found & np.uint32(31)
        return np.ascontiguousarray(out.T).reshape(-1)[:n] >> np.uint32(5)


# ---- writing ----------------------------------------------------------

def _ids(path, end_id):
    def run(batches):
        import zstandard
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            doc = batch.column(0).cast(pa.int64())
            buf, off = ta.utf8(batch.column(1))
            for a, b in ta.slices(off):
                flat, first = with_end(*tokenizer(path).encode(buf[off[a]:off[b]], off[a:b + 1] - off[a]), end_id)
                kind = "<u2" if int(flat.max()) < 1 << 16 else "<u4"
                raw = flat.astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(a, b - a), pa.array(np.diff(first)), pa.array([kind] * (b - a)),
                     pa.array([z.compress(raw[first[i]:first[i + 1]].tobytes()) for i in range(b - a)], pa.binary())],
                    names=["doc_id", "n_tokens", "kind", "ids"])
    return run


def _unpack(z, kind, data) -> np.ndarray:
    return np.frombuffer(z.decompress(data), kind)


def _counted(batches):
    import zstandard
    release()
    z = zstandard.ZstdDecompressor()
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        kinds, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a in range(0, len(data), 256):
            ids = np.concatenate([_unpack(z, k, d) for k, d in zip(kinds[a:a + 256], data[a:a + 256])])
            c = np.bincount(ids, minlength=len(total))
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
            total += c
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])


def _segments(length, segment, block):
    code = canonical(length)

    def close(shard, first, doc, ids):
        flat = np.concatenate(ids)
        payload, at = encode_bits(flat, code, length)
        known = np.array([d is not None for d in doc], np.uint8)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([len(flat)], pa.int64()),
             pa.array([np.array([d or 0 for d in doc], "<i8").tobytes()], pa.binary()), pa.array([known.tobytes()], pa.binary()),
             pa.array([np.array([len(i) for i in ids], "<i8").tobytes()], pa.binary()),
             pa.array([payload], pa.binary()), pa.array([at[:-1][::block].astype("<i8").tobytes()], pa.binary())],
            names=[c.split()[0] for c in SEGMENTS.split(", ")])

    def run(batches):
        import zstandard
        release()
        z = zstandard.ZstdDecompressor()
        shard, first, held, doc, ids = None, 0, 0, [], []
        for batch in batches:
            for s, d, kind, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x = _unpack(z, kind, data)
                if ids and (s != shard or held + len(x) > segment):
                    yield close(shard, first, doc, ids)
                    first = first + held if s == shard else 0
                    held, doc, ids = 0, [], []
                shard = s
                doc.append(d)
                ids.append(x)
                held += len(x)
        if ids:
            yield close(shard, first, doc, ids)
    return run


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, most: int = MAX_LENGTH) -> None:
    """Tokenise whole documents and write them to ``folder`` in the format."""
    spark = docs.sparkSession
    s = Scratch(spark)
    raw = s.keep(docs.select("doc_id", "text").mapInArrow(_ids(path, end_id), "doc_id long, n_tokens long, kind string, ids binary"), "ids")
    counts = raw.select("kind", "ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.toPandas()  # one row per vocabulary entry at most
    n = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    n[rows["id"]] = rows["n"]
    length = code_lengths(n, most)
    used = np.flatnonzero(length)
    codes = spark.createDataFrame([(int(i), int(length[i])) for i in used], "id long, length int")
    codes.coalesce(1).write.mode("overwrite").parquet(f"{folder}/codes")
    order = ("doc_id", "n_tokens", "ids_hash")  # rows of one id, or of none, are split as well
    placed = (raw.withColumn("ids_hash", F.xxhash64("ids")).repartitionByRange(*order).sortWithinPartitions(*order)
              .select(F.spark_partition_id().alias("shard"), "doc_id", "kind", "ids"))
    placed.mapInArrow(_segments(length, SEGMENT, BLOCK), SEGMENTS).write.mode("overwrite").option("compression", "none").parquet(f"{folder}/segments")
    s.drop(raw)


# ---- reading ----------------------------------------------------------

def _read(length, block, checksums):
    """Decoded documents; with ``checksums`` in place of their ids."""
    def run(batches):
        release()
        decoder = Decoder(length)
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                flat = decoder.decode(row["payload"], np.frombuffer(row["checkpoints"], "<i8"), row["n_ids"], block)
                doc, size = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["sizes"], "<i8")
                ends = np.cumsum(size)
                raw = memoryview(flat.astype("<u4")).cast("B")
                parts = (raw[4 * a:4 * b] for a, b in zip((ends - size).tolist(), ends.tolist()))
                last = pa.array(map(zlib.crc32, parts), pa.int64()) if checksums else pa.array(list(parts), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(doc), pa.int32()), pa.array(row["first_id"] + ends - size, pa.int64()),
                     pa.array(doc, pa.int64(), mask=np.frombuffer(row["known"], np.uint8) == 0), pa.array(size, pa.int64()), last],
                    names=["shard", "at", "doc_id", "n_tokens", "ids_crc32" if checksums else "ids"])
    return run


def _decoded(spark: SparkSession, folder: str, checksums: bool) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/codes").collect()  # one row per vocabulary entry at most
    length = np.zeros(max((r.id for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        length[r.id] = r.length
    segments = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments")
    return segments.mapInArrow(_read(length, BLOCK, checksums), "shard int, at long, doc_id long, n_tokens long, "
                               + ("ids_crc32 long" if checksums else "ids binary"))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """One row per stored document: shard, at (ids before it in its shard),
    doc_id, n_tokens, ids (little-endian unsigned 32-bit)."""
    return _decoded(spark, folder, False)


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32.
    Checksums are formed where the ids are decoded: a second Python step
    would put a second worker beside each task."""
    sums = (spark.read.schema(SEGMENTS).parquet(f"{folder}/segments").groupBy("shard").agg(F.sum("n_ids").alias("n"))
            .select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before")))  # one row per shard
    docs = _decoded(spark, folder, True).join(sums, "shard")
    return docs.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_id_files(docs: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write, read back and digest; the folder defaults to a scratch one."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    write_ids(docs, path, folder, end_id)
    return digest(docs.sparkSession, folder)
