"""Exact selection by radix refinement: order statistics and the first k rows
without a sort and without an exchange that carries rows.

A value becomes a signed 64-bit key in the value's order. A pass counts, in
each task and for every column and group at once, the keys of at most 2^16
buckets and remembers each bucket's smallest and largest key; the exchange
carries these counts only. The bucket that holds the wanted rank becomes the
next pass's range and is cut into 2^16 again, so four passes always find the
key, and a bucket that holds one key ends the search at once.

What the driver holds between passes is one row per wanted rank and group
(``STATES`` at most; :func:`order_statistics` returns None beyond it and its
caller sorts instead).

``first_rows`` finds the key of the k-th row, column after column for ties, and
keeps rows up to it with one map-only filter; only rows that are equal in every
order column are told apart by a ``limit``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 16
STATES = 100_000  # ranks x groups x columns that the driver may hold
HOLD = 200_000    # counted rows that a task keeps before it sends them on
TOP = np.int64(0x7FFFFFFFFFFFFFFF)


def ordered_keys(values: np.ndarray) -> np.ndarray:
    """Signed 64-bit keys in the values' order; -0.0 equals 0.0."""
    if values.dtype.kind == "f":
        bits = (values.astype(np.float64) + 0.0).view(np.int64)
        return np.where(bits < 0, bits ^ TOP, bits)
    return values.astype(np.int64)


def key_value(key: int, is_float: bool) -> float | int:
    if not is_float:
        return int(key)
    bits = np.int64(key)
    return float(np.where(bits < 0, bits ^ TOP, bits).astype(np.int64).view(np.float64))


@dataclass
class _Range:
    """A searched range of one column and group: keys from ``low`` in buckets
    of 2^shift, up to ``high``."""
    group: tuple
    column: int
    low: int
    high: int

    @property
    def shift(self) -> int:
        return max(0, (self.high - self.low).bit_length() - BITS)


def _members(batch: pa.RecordBatch, by: Sequence[str], groups: list[tuple]) -> np.ndarray:
    """Number of each row's group in ``groups``, -1 for others."""
    code = np.zeros(batch.num_rows, np.int64)
    combo = np.zeros(len(groups), np.int64)
    for i, b in enumerate(by):
        col = batch.column(batch.schema.get_field_index(b))
        known = list(dict.fromkeys(g[i] for g in groups))
        at = pc.index_in(col, pa.array(known, col.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place = {v: j for j, v in enumerate(known)}
        code = np.where((at < 0) | (code < 0), -1, code * len(known) + at)
        combo = combo * len(known) + np.array([place[g[i]] for g in groups], np.int64)
    order = np.argsort(combo)
    at = np.minimum(np.searchsorted(combo[order], code), len(groups) - 1)
    return np.where(combo[order][at] == code, order[at], -1)


def _counter(cols: Sequence[str], by: Sequence[str], ranges: list[_Range] | None) -> Callable:
    """Counts of keys per group, column, range and bucket, with the bucket's
    smallest and largest key; null and NaN count in bucket null. Without
    ranges the buckets are the keys' top 16 bits."""
    hold = HOLD
    groups = list(dict.fromkeys(r.group for r in ranges)) if ranges is not None else []
    number = {g: i for i, g in enumerate(groups)}
    mine: dict[int, tuple] = {}
    for c in range(len(cols)) if ranges is not None else ():
        own = sorted(((number[r.group], r.low, r.high, r.shift, i) for i, r in enumerate(ranges) if r.column == c))
        mine[c] = tuple(np.array(x, np.int64) for x in zip(*own)) if own else None

    def counted(batch):
        gid = _members(batch, by, groups) if ranges is not None and by else np.zeros(batch.num_rows, np.int64)
        for c, name in enumerate(cols):
            col = batch.column(batch.schema.get_field_index(name))
            ok = col.is_valid().to_numpy(zero_copy_only=False)
            raw = col.fill_null(0).to_numpy(zero_copy_only=False)
            if raw.dtype.kind == "f":
                ok = ok & ~np.isnan(raw)
            rows = np.flatnonzero(ok)
            key = ordered_keys(raw[rows])
            span = np.zeros(len(rows), np.int64)
            if ranges is None:
                bucket = key >> np.int64(64 - BITS)
            elif mine[c] is None:
                continue
            else:
                g, low, high, shift, which = mine[c]
                # ranges of a group do not overlap: the last that begins at or below the key
                at = np.zeros(len(rows), np.int64)
                for i in np.unique(gid[rows]):
                    part = np.flatnonzero(gid[rows] == i) if by else slice(None)
                    a, b = np.searchsorted(g, i), np.searchsorted(g, i, side="right")
                    at[part] = a - 1 + np.searchsorted(low[a:b], key[part], side="right")
                    at[part] = np.where(at[part] < a, -1, at[part])
                hit = (at >= 0) & (key <= high[at])
                rows, key, at = rows[hit], key[hit], at[hit]
                span, bucket = which[at], (key - low[at]) >> shift[at]
            t = {b: batch.column(batch.schema.get_field_index(b)).take(pa.array(rows)) for b in by}
            t |= {"column": pa.array(np.full(len(rows), c), pa.int32()), "span": span, "bucket": bucket, "key": key}
            yield _grouped(pa.table(t), [*by, "column", "span", "bucket"], [("key", "count"), ("key", "min"), ("key", "max")])
            if ranges is None and not ok.all():
                none = np.flatnonzero(~ok)
                t = {b: batch.column(batch.schema.get_field_index(b)).take(pa.array(none)) for b in by}
                t |= {"column": pa.array(np.full(len(none), c), pa.int32()), "span": np.zeros(len(none), np.int64),
                      "bucket": pa.nulls(len(none), pa.int64()), "key": np.zeros(len(none), np.int64)}
                yield _grouped(pa.table(t), [*by, "column", "span", "bucket"], [("key", "count"), ("key", "min"), ("key", "max")])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for t in counted(batch):
                held.append(t)
                n += len(t)
            if n > hold:
                held = [_grouped(pa.concat_tables(held), [*by, "column", "span", "bucket"], [("n", "sum"), ("low", "min"), ("high", "max")])]
                n = len(held[0])
                if n > hold // 2:
                    yield from held[0].to_batches()
                    held, n = [], 0
        if held:
            yield from _grouped(pa.concat_tables(held), [*by, "column", "span", "bucket"], [("n", "sum"), ("low", "min"), ("high", "max")]).to_batches()
    return run


def _grouped(t: pa.Table, keys: list[str], aggs) -> pa.Table:
    out = t.group_by(keys).aggregate(aggs)
    return out.select([*keys, *(f"{c}_{f}" for c, f in aggs)]).rename_columns([*keys, "n", "low", "high"])


def _histogram(df: DataFrame, cols: Sequence[str], by: Sequence[str], ranges: list[_Range] | None) -> DataFrame:
    fields = [*(df.schema[b] for b in by), T.StructField("column", T.IntegerType()),
              *(T.StructField(c, T.LongType()) for c in ("span", "bucket", "n", "low", "high"))]
    counts = df.select(*by, *cols).mapInArrow(_counter(cols, by, ranges), T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
    return counts.groupBy(*by, "column", "span", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _running(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """``start`` and ``end``: ranks of each bucket inside its range. A window
    holds at most 2^16 buckets."""
    w = Window.partitionBy(*by, "column", "span").orderBy("bucket")
    end = F.sum("n").over(w)
    return hist.where("bucket is not null").withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))


@dataclass
class Pick:
    """The key at one rank: keys below it, keys equal to it."""
    group: tuple
    column: int
    n: int       # keys of the group and column
    rank: int
    key: int
    below: int
    equal: int


def select_ranks(df: DataFrame, cols: Sequence[str], ranks: Callable[[Column], Column], by: Sequence[str] = ()) -> tuple[list[Pick], dict[tuple, int]] | None:
    """Keys at given ranks of every column and group, and the null (or NaN)
    count of each (group, column). ``ranks`` turns the count into an array of
    0-based ranks; those outside the count are left out. None when there are
    more than STATES of them."""
    by, cols = list(by), list(cols)
    first = _histogram(df, cols, by, None)
    total = F.sum("n").over(Window.partitionBy(*by, "column"))
    level = _running(first, by).withColumn("total", total)
    want = F.filter(F.array_distinct(ranks(F.col("total"))), lambda r: (r >= F.col("start")) & (r < F.col("end")))
    hits = level.select(*by, "column", "low", "high", "n", "start", "total", F.explode(want).alias("rank"))
    nulls = first.where("bucket is null").select(*by, "column", F.lit(0).alias("low"), F.lit(0).alias("high"), "n",
                                                 F.lit(0).alias("start"), F.lit(0).alias("total"), F.lit(-1).cast("long").alias("rank"))
    rows = hits.union(nulls).limit(STATES + 1).collect()
    if len(rows) > STATES:
        return None
    missing = {(tuple(r[b] for b in by), r.column): r.n for r in rows if r["rank"] < 0}
    out: list[Pick] = []
    todo = []
    for r in rows:
        if r["rank"] >= 0:
            todo.append((Pick(tuple(r[b] for b in by), r.column, r.total, r["rank"], r.low, r.start, r.n), r.high))
    while todo:
        out += [p for p, high in todo if p.key == high]
        todo = [(p, high) for p, high in todo if p.key != high]
        ranges, place = [], {}
        for p, high in todo:
            k = (p.group, p.column, p.key)
            if k not in place:
                place[k] = len(ranges)
                ranges.append(_Range(p.group, p.column, p.key, high))
        if not ranges:
            break
        wanted: dict[int, list[Pick]] = {}
        for p, _ in todo:
            wanted.setdefault(place[p.group, p.column, p.key], []).append(p)
        targets = df.sparkSession.createDataFrame([(i, p.rank - p.below) for i, ps in wanted.items() for p in ps], "span long, at long")
        level = _running(_histogram(df, cols, by, ranges), by)
        found = (level.join(targets, "span").where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
                 .select("span", "at", "low", "high", "n", "start").collect())  # a row per target
        todo = []
        seen = {(r.span, r["at"]): r for r in found}
        for i, ps in wanted.items():
            for p in ps:
                r = seen[i, p.rank - p.below]
                todo.append((Pick(p.group, p.column, p.n, p.rank, r.low, p.below + r.start, r.n), r.high))
    return out, missing


def _lower(p: float, n: Column) -> tuple[Column, Column]:
    at = (n - 1).cast("double") * F.lit(float(p))
    return F.floor(at).cast("long"), F.ceil(at).cast("long")


def order_statistics(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> list[Row] | None:
    """Exact quantiles (linear between the two order statistics around
    ``p (n - 1)``) of numeric columns, null and NaN left out: rows (group,
    column number, n, [quantiles]); None when there are too many groups."""
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    found = select_ranks(wide, cols, lambda n: F.array(*[r for p in probs for r in _lower(p, n)]), by)
    if found is None:
        return None
    at: dict[tuple, dict[int, float]] = {}
    size: dict[tuple, int] = {}
    for p in found[0]:
        at.setdefault((p.group, p.column), {})[p.rank] = key_value(p.key, True)
        size[p.group, p.column] = p.n
    out = []
    for k, values in at.items():
        row = []
        for p in probs:
            place = float(size[k] - 1) * float(p)
            lo, hi, d = values[int(np.floor(place))], values[int(np.ceil(place))], place - np.floor(place)
            row.append(lo if d == 0 else lo + (hi - lo) * float(d))
        out.append(Row(group=k[0], column=k[1], n=size[k], quantiles=row))
    return out


@dataclass
class Key:
    """An order column: a double (NaN counts as null), or an integer."""
    col: Column
    descending: bool = False
    nulls_last: bool = False


def first_rows(df: DataFrame, order: Sequence[Key], k: int) -> tuple[DataFrame, Column | None]:
    """The first ``k`` rows along ``order`` and the condition that picks them
    from ``df``; None in its place if rows that are equal in every order column
    had to be told apart by a limit. Per order column that is reached one count
    and a few passes run when called."""
    names = [f"_key{i}" for i in range(len(order))]
    types = df.select(*[o.col.alias(n) for n, o in zip(names, order)]).schema
    is_float = [f.dataType.typeName() in ("double", "float", "decimal") for f in types]
    keys = [F.when(~F.isnan(o.col.cast("double")), o.col.cast("double")) if x else o.col.cast("long") for o, x in zip(order, is_float)]
    taken, same, left = F.lit(False), F.lit(True), k
    for o, c, x in zip(order, keys, is_float):
        here = df.where(same).select(c.alias("key"))
        total, filled = here.agg(F.count(F.lit(1)), F.count("key")).first()
        if left >= total:  # every row that is equal so far
            return df.where(taken | same), taken | same
        parts = [(c.isNotNull(), filled, True), (c.isNull(), total - filled, False)]
        for part, size, valued in parts if o.nulls_last else parts[::-1]:
            if left < size:
                break
            taken, left = taken | (same & part), left - size
        if left == 0:
            return df.where(taken), taken
        same = same & part  # the part that holds the k-th row
        if valued:
            rank = size - left if o.descending else left - 1
            pick = select_ranks(here, ["key"], lambda n: F.array(F.lit(rank).cast("long")))[0][0]
            v = F.lit(key_value(pick.key, x))
            taken, same = taken | (same & ((c > v) if o.descending else (c < v))), same & (c == v)
            left -= size - pick.below - pick.equal if o.descending else pick.below
            if left == pick.equal:
                return df.where(taken | same), taken | same
    return df.where(taken).union(df.where(same).limit(left)), None
