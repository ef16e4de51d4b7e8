"""N-gram Jaccard join by MinHash banding (operator 6).

Documents are sets of five-word shingles (lower case, words between ASCII
white space; a text of one to four words is one shingle). Pairs of
similarity 0.8 or more are links; linked documents form classes.

Plan, all tables in the shared scratch folder:

1. one Arrow pass: shingle-set hash (the *node*), set size, band hashes. Band
   and row counts come from the target recall (``bands_for``).
2. documents of equal sets collapse to one node (partial aggregation, so a
   group of a billion copies costs one row per task).
3. shuffle on band hashes; buckets of one node fall away.
4. buckets of at most ``SMALL`` nodes list their pairs in the row; the pairs
   are verified on the full shingle sets. Larger buckets are not listed:
   nodes that share such buckets are merged into hot groups, dealt into
   blocks of ``TILE`` to ``BLOCK`` nodes, and every pair of blocks is one task
   that multiplies incidence matrices tile by tile, counts links and emits one
   row per node; a group of n nodes sends each set 8 or n / BLOCK times.
   Nothing is dropped or capped: every pair that shares a band is verified
   on its whole sets, and a hot group's pairs all are, band or not.
5. components of the verified links; one row per document comes back.

Texts are fetched again by (doc_id, hash of the text), so ids need be neither
unique nor present.

Defined results: null or blank texts have no shingles, form their own class
and have no links; a row with null doc_id is linked like any other but never
names a class (class_id is the smallest id of the class, null if it has none);
repeated rows are copies of each other; rows of one id with different texts are
different documents; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from . import textarr as ta
from .components import components

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.995
HASHES = 128
SMALL = 32
BLOCK = 4096  # most nodes of a hot group whose sets travel together
TILE = 512    # sets multiplied at once
SEED = 20231
TEXT = "_text_hash"
WORD = r"[^\x20\x09-\x0D]"


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``most`` hashes
    that finds a pair at ``threshold`` with probability ``recall`` or more."""
    for rows in range(most, 0, -1):
        p = threshold ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding of so few hashes reaches this recall")


def shingles(buf, off, n: int = NGRAM):
    """Sorted distinct shingle hashes of each document, one array at a time."""
    w = ta.words(buf, off)
    pos, group = ta.windows(w.first, n)
    h = ta.segment_hash(w.hash, pos, pos + n)
    bound = np.searchsorted(group, np.arange(len(off)))
    for d in range(len(off) - 1):
        if bound[d + 1] > bound[d]:
            yield np.unique(h[bound[d]:bound[d + 1]])
        else:
            a, b = w.first[d], w.first[d + 1]
            yield ta.segment_hash(w.hash, np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64)


def _texts(column):
    """Slices of lower-cased text: (first row, bytes, offsets)."""
    if column.null_count:
        column = column.fill_null("")
    buf, off = ta.utf8(pc.utf8_lower(column.cast(pa.large_string())))
    for a, b in ta.slices(off):
        yield a, buf[off[a]:off[b]], off[a:b + 1] - off[a]


def _node(s: np.ndarray) -> int:
    return int(ta.segment_hash(s, np.array([0]), np.array([len(s)])).view(np.int64)[0])


def _signer(n, bands, rows):
    rng = np.random.default_rng(SEED)
    xor = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None]
    mul = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
    first = np.arange(bands) * rows

    def minima(s):
        low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
        h = (s >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(h), 2048):
            x = (h[None, i:i + 2048] ^ xor) * mul
            np.minimum(low, (x ^ (x >> np.uint32(15))).min(axis=1), out=low)
        return low

    def run(batches):
        for batch in batches:
            ids, text_hash = batch.column(0).cast(pa.int64()), batch.column(2)
            for a, buf, off in _texts(batch.column(1)):
                node, size, sig = [], [], []
                for s in shingles(buf, off, n):
                    size.append(len(s))
                    if len(s) == 0:
                        node.append(None)
                        sig.append(np.zeros(0, np.int64))
                        continue
                    node.append(_node(s))
                    keyed = ta.segment_hash(minima(s), first, first + rows) + np.arange(bands, dtype=np.uint64)
                    sig.append(ta.mix(keyed).view(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sig])])
                flat = pa.array(np.concatenate(sig) if sig else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, len(node)), text_hash.slice(a, len(node)), pa.array(node, pa.int64()), pa.array(size, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                    names=["doc_id", TEXT, "node", "n_sh", "bands"])
    return run


def signatures(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, hash of the text, node (hash of the shingle set, null when
    empty), n_sh, bands."""
    return keyed(docs).select("doc_id", "text", TEXT).mapInArrow(
        _signer(n, *bands_for(threshold, recall)), f"doc_id long, {TEXT} long, node long, n_sh int, bands array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the hash of each text: (doc_id, hash) names a text."""
    return docs.withColumn(TEXT, F.xxhash64("text"))


def same_text(a: DataFrame, b: DataFrame):
    """Join condition: the same text, id null or not."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a[TEXT] == b[TEXT])


def _with_first(frame: DataFrame) -> DataFrame:
    """``first`` as columns: id and text hash of a node's first row."""
    return frame.select("*", "first.doc_id", f"first.{TEXT}")


def _setter(n):
    def run(batches):
        sent = set()  # repeated rows of a document stand in one task
        for batch in batches:
            want = batch.column(0).to_numpy(zero_copy_only=False)
            for a, buf, off in _texts(batch.column(1)):
                node, sets = [], []
                for i, s in enumerate(shingles(buf, off, n)):
                    if len(s) and (x := _node(s)) == want[a + i] and x not in sent:
                        sent.add(x)
                        node.append(x)
                        sets.append(s)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                flat = pa.array((np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                                                 names=["node", "sh"])
    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of ``left`` with all of ``right``: the
    product of two 0/1 incidence matrices, 4096 shingles at a time."""
    flat = np.concatenate(left + right)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    _, col, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen > 1
    number = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], number[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(left), len(right)), np.float32)
    total = int(number[-1]) + 1 if len(number) else 0
    for c in range(0, total, 4096):
        i, j = np.searchsorted(col, (c, c + 4096))
        m = np.zeros((len(left) + len(right), min(4096, total - c)), np.float32)
        m[row[i:j], col[i:j] - c] = 1
        out += m[:len(left)] @ m[len(left):].T
    return out


def _linked(left, right, threshold):
    inter = _overlaps(left, right).astype(np.float64)
    total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return inter >= threshold * (total - inter)


def _rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number of each node's component over the edges a - b."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _block_pair(threshold, tile=TILE):
    """One task: links between two blocks of a hot group (or inside one),
    ``tile`` sets against ``tile`` sets at a time."""
    def run(key, t):
        same = key[1].as_py() == key[2].as_py()
        node, pick = np.unique(t.column("node").to_numpy(), return_index=True)
        side = t.column("side").to_numpy()[pick]
        copies = t.column("copies").to_numpy()[pick].astype(np.int64)
        flat = t.column("sh").combine_chunks()
        off, vals = flat.offsets.to_numpy(), flat.values.to_numpy().view(np.uint64)
        n = len(node)
        left, right = (np.arange(n),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        n_links, edges = np.zeros(n, np.int64), [np.zeros((2, 0), np.int64)]
        for i in range(0, len(left), tile):
            for j in range(i if same else 0, len(right), tile):
                x, y = left[i:i + tile], right[j:j + tile]
                a, b = np.nonzero(_linked([vals[off[k]:off[k + 1]] for k in pick[x]], [vals[off[k]:off[k + 1]] for k in pick[y]], threshold))
                a, b = x[a], y[b]
                once = a < b if same and i == j else np.ones(len(a), bool)
                a, b = a[once], b[once]
                np.add.at(n_links, a, copies[b])
                np.add.at(n_links, b, copies[a])
                low = _rooted(n, a, b)  # a spanning set of this tile's links is enough
                edges.append(np.stack([np.flatnonzero(low != np.arange(n)), low[low != np.arange(n)]]))
        low = _rooted(n, *np.concatenate(edges, axis=1))
        return pa.table({"node": node, "n_links": n_links, "root": node[low] if n else node})
    return run


def _hot_groups(hot: DataFrame, s: Scratch) -> DataFrame:
    """(node, grp): nodes that share large buckets, directly or in steps."""
    low = s.keep(hot.groupBy("key").agg(F.min("node").alias("low")), "low")  # written, so that the join can split hot keys
    both = components(hot.join(low, "key").select(F.col("node").alias("a"), F.col("low").alias("b")))
    s.drop(low)
    return both.select("node", F.col("root").alias("grp"))


def _classes(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and per node its class: (node, class_id, head,
    n_links); ``head`` is the first row of the class: by id (null last), then
    hash of the text."""
    s = Scratch(docs.sparkSession)
    sig = s.keep(signatures(docs, n, threshold, recall), "sig")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", TEXT))
    classes = s.keep(sig.where("node is not null").groupBy("node").agg(
        first.alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n_sh").alias("n_sh"),
        F.first("bands").alias("bands")), "classes")
    nodes = classes.select("node", "n_sh", "copies")
    spread = classes.select("node", "n_sh", F.explode("bands").alias("key"))
    live = s.keep(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "live")
    members = s.keep(spread.join(live, "key"), "members")
    s.drop(live)

    hot = members.where(F.col("n") > SMALL)
    grp = _hot_groups(hot, s)

    # small buckets: pairs listed in the row, unless a hot group covers them
    m = members.where(F.col("n") <= SMALL).join(grp, "node", "left")
    lists = m.groupBy("key").agg(F.collect_list(F.struct("node", "n_sh", "grp")).alias("m"))

    def pairs_of(ms):
        return F.flatten(F.transform(ms, lambda x: F.transform(
            F.filter(ms, lambda y: (y.node > x.node) & F.coalesce(y.grp != x.grp, F.lit(True))
                     & (F.least(x.n_sh, y.n_sh) >= threshold * F.greatest(x.n_sh, y.n_sh))),
            lambda y: F.struct(x.node.alias("a"), y.node.alias("b")))))
    pairs = s.keep(lists.select(F.explode(pairs_of(F.col("m"))).alias("p")).select("p.a", "p.b").distinct(), "pairs")
    s.drop(members)

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(grp.select("node")).distinct()
    who = s.keep(_with_first(wanted.join(classes.select("node", "first"), "node")).select("node", "doc_id", TEXT), "wanted")
    rows = keyed(docs.select("doc_id", "text")).hint("merge")
    texts = rows.join(who, same_text(rows, who))
    sets = s.keep(texts.select("node", "text").mapInArrow(_setter(n), "node long, sh array<long>"), "sets")
    s.drop(who)

    sa, sb = (sets.select(F.col("node").alias(c), F.col("sh").alias(f"sh_{c}")) for c in "ab")
    inter = F.size(F.array_intersect("sh_a", "sh_b"))
    cold = s.keep(pairs.join(sa, "a").join(sb, "b").withColumn("i", inter)
                  .where(F.col("i") >= threshold * (F.size("sh_a") + F.size("sh_b") - F.col("i")))
                  .select("a", "b").distinct(), "links")
    s.drop(pairs)

    size = F.count(F.lit(1))  # a group is dealt into eight blocks or more, none under a tile nor over BLOCK
    blocks = grp.groupBy("grp").agg(F.ceil(size / F.least(F.lit(BLOCK), F.greatest(F.lit(TILE), size / 8))).cast("int").alias("nb"))
    dealt = (grp.join(blocks, "grp").join(nodes.select("node", "copies"), "node")
             .withColumn("i", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).join(sets, "node")
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .select("grp", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"),
                     F.when(F.col("i") <= F.col("j"), 0).otherwise(1).alias("side"), "node", "copies", "sh"))
    warm = s.keep(dealt.groupBy("grp", "lo", "hi").applyInArrow(_block_pair(threshold), "node long, n_links long, root long"), "hot")

    comp = components(cold.select("a", "b").union(warm.select("node", "root")))
    ends = cold.select(F.col("a").alias("node"), F.col("b").alias("peer")).union(cold.select("b", "a"))
    degree = (ends.join(nodes.select(F.col("node").alias("peer"), "copies"), "peer").select("node", F.col("copies").alias("n"))
              .union(warm.select("node", "n_links")).groupBy("node").agg(F.sum("n").alias("linked")))
    rooted = s.keep(classes.drop("bands").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
                    .join(degree, "node", "left")
                    .select("node", "root", "first", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "rooted")
    heads = s.keep(rooted.groupBy("root").agg(F.min("first").alias("head")), "heads")
    named = s.keep(rooted.join(heads, "root").select("node", F.col("head.doc_id").alias("class_id"), "head", "n_links"), "named")
    s.drop(rooted, heads, sets, classes, cold, warm, comp)
    return sig, named


def ngram_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest id of the
    documents reachable over links), n_links (other rows at ``threshold`` or
    more, copies included), n_shingles."""
    sig, named = _classes(docs, n, threshold, recall)
    return (sig.select("doc_id", "node", "n_sh").join(named, "node", "left")
            .select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.col("n_sh").cast("long").alias("n_shingles")))


def keep_one(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class, all its columns: the one of the
    smallest id (rows without an id come last, ties go by a hash of the text).
    Texts without words are no copies of each other and stay."""
    heads = _classes(docs, n, threshold, recall)[1].select("head").distinct().select(
        F.col("head.doc_id").alias("doc_id"), F.col(f"head.{TEXT}").alias(TEXT))
    rows = keyed(docs)
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    kept = rows.where(worded).hint("merge")
    kept = kept.join(heads, same_text(kept, heads), "left_semi").dropDuplicates(["doc_id", TEXT])
    return kept.select(docs.columns).union(docs.where(~worded))
