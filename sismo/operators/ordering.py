"""Global row order without a global window.

An unpartitioned window (``Window.orderBy`` without ``partitionBy``) moves
every row into one task. Instead rows are range-partitioned on the order key
(Spark samples the key, so a hot value is split by the tie-break columns) and
sorted inside the partitions: one exchange. ``monotonically_increasing_id``
then holds the partition in its high bits and the local position in its low
33 bits. The numbered rows are written once to the shared scratch folder,
since the range partitioner samples its bounds anew whenever a shuffle is
planned: offsets and rows then come from the same files, and a lost executor
cannot make them disagree. The offset table has one row per partition.

Interpolation is a segmented scan of two levels: inside windows of a sorted
partition neighbours are found by whole-array operations in the same pass;
a null stretch that outlasts its window is a numbered gap whose end joins back
by one row per gap, and partition borders are crossed by the same
one-row-per-partition table.

``with_position`` and ``interpolate_linear`` therefore run one write job when
they are called; ``session.release_scratch`` deletes what they wrote.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FEATURES
from ..session import cut_lineage

MID, PID = "_mid", "_pid"
LOCAL_BITS = 33
LOCAL_MASK = (1 << LOCAL_BITS) - 1
WINDOW_ROWS = 1 << 16


def time_order(ts: str = "datetime", tie: str = "event_id") -> list[Column]:
    """(datetime ascending, nulls last; event_id) — the explicit form of the
    reference's sort by datetime."""
    return [F.col(ts).asc_nulls_last(), F.col(tie).asc()]


def sorted_by_range(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """Rows in global order (partition after partition), numbered by ``_mid``.
    The only exchange of every operator in this module."""
    n = int(partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
            .withColumn(MID, F.monotonically_increasing_id()))


def part_of(mid: str = MID) -> Column:
    return F.shiftright(F.col(mid), LOCAL_BITS)


def place_of(mid: str = MID) -> Column:
    return F.col(mid).bitwiseAND(F.lit(LOCAL_MASK))


def offsets(local: DataFrame, size: Column | None = None, extra_aggs: Sequence[Column] = ()) -> DataFrame:
    """Per partition: ``_off`` = rows (or ``size``) in all earlier partitions,
    plus the extra aggregates. One row per partition."""
    per = local.groupBy(part_of().alias(PID)).agg((F.count(F.lit(1)) if size is None else size).alias("_n"), *extra_aggs)
    before = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long"))


def with_position(df: DataFrame, order: Sequence[Column] | None = None, pos: str = "pos",
                  partitions: int | None = None) -> DataFrame:
    """Add a 0-based position in the global ``order`` (dense, unique)."""
    local = cut_lineage(sorted_by_range(df, list(order or time_order()), partitions), "ordered")
    offs = offsets(local).select(PID, "_off")
    return (local.withColumn(PID, part_of()).join(F.broadcast(offs), PID)  # a row per partition
            .withColumn(pos, F.col("_off") + place_of())
            .drop(PID, MID, "_off"))


def sort_by_time(df: DataFrame, ts: str = "datetime", tie: str = "event_id",
                 pos: str = "pos", partitions: int | None = None) -> DataFrame:
    """Order by datetime (nulls last, ties by id) and number the rows."""
    return with_position(df, time_order(ts, tie), pos, partitions)


def _filled(have: np.ndarray, back: bool) -> np.ndarray:
    """Index of the nearest true entry at or before (after) each row, -1 if
    there is none."""
    if back:
        i = _filled(have[::-1], False)[::-1]
        return np.where(i >= 0, len(have) - 1 - i, -1)
    return np.maximum.accumulate(np.where(have, np.arange(len(have)), -1))


def _neighbours(cols: Sequence[str], window_rows: int):
    """Adds to every row, per column, place and value of the nearest non-null
    rows before and after it (null when there is none). The rows of a sorted
    partition pass in windows of ``window_rows``. What lies before is carried
    along; a null whose next value lies beyond its window gets the number of
    its gap instead (``_gap_``), and the row that ends such a gap names it
    (``_closes_``). So no row waits, however long a column stays null."""
    def emit(window: pa.RecordBatch, last: dict, gap: dict) -> pa.RecordBatch:
        place = window.column(window.schema.get_field_index(MID)).to_numpy() & LOCAL_MASK
        n = len(place)
        extra, names = [], []
        for c in cols:
            col = window.column(window.schema.get_field_index(c))
            have = col.is_valid().to_numpy(zero_copy_only=False)
            value = col.fill_null(0.0).to_numpy(zero_copy_only=False)
            i, j = _filled(have, False), _filled(have, True)
            p, v, none = place[i], value[i], i < 0
            if c in last:
                p, v, none = np.where(none, last[c][0], p), np.where(none, last[c][1], v), np.zeros(n, bool)
            late = j < 0
            closes, closed = np.zeros(n, np.int64), np.zeros(n, bool)
            if have.any():
                first, end = int(np.argmax(have)), n - 1 - int(np.argmax(have[::-1]))
                if c in gap:
                    closes[first], closed[first] = gap.pop(c), True
                last[c] = (place[end], value[end])
            if late.any():
                gap.setdefault(c, int(place[np.argmax(late)]))
            extra += [pa.array(p, pa.int64(), mask=none), pa.array(v, pa.float64(), mask=none),
                      pa.array(place[j], pa.int64(), mask=late), pa.array(value[j], pa.float64(), mask=late),
                      pa.array(np.full(n, gap.get(c, 0)), pa.int64(), mask=~late), pa.array(closes, pa.int64(), mask=~closed)]
            names += [f"_prev_p_{c}", f"_prev_v_{c}", f"_next_p_{c}", f"_next_v_{c}", f"_gap_{c}", f"_closes_{c}"]
        return pa.RecordBatch.from_arrays([*window.columns, *extra], names=[*window.schema.names, *names])

    def run(batches):
        held, rows = [], 0
        last, gap = {}, {}
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= window_rows:
                yield emit(pa.Table.from_batches(held).combine_chunks().to_batches()[0], last, gap)
                held, rows = [], 0
        if rows:
            yield emit(pa.Table.from_batches(held).combine_chunks().to_batches()[0], last, gap)
    return run


def _with_gaps_closed(local: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Next values of the rows in gaps that outlast a window, from one row per
    gap; all other rows pass without a join."""
    inside = reduce(lambda a, b: a | b, [F.col(f"_gap_{c}").isNotNull() for c in cols])
    opened = local.where(inside).withColumn(PID, part_of())
    for c in cols:
        ends = local.where(F.col(f"_closes_{c}").isNotNull()).select(
            part_of().alias(PID), F.col(f"_closes_{c}").alias(f"_gap_{c}"), place_of().alias("_end_p"), F.col(c).alias("_end_v"))
        opened = opened.join(ends, [PID, f"_gap_{c}"], "left").withColumns(
            {f"_next_{k}_{c}": F.coalesce(f"_next_{k}_{c}", f"_end_{k}") for k in "pv"}).drop("_end_p", "_end_v")
    return local.where(~inside).unionByName(opened.drop(PID))


def interpolate_linear(df: DataFrame, cols: Sequence[str] = ("magnitude", "depth"),
                       order: Sequence[Column] | None = None, pos: str = "pos",
                       partitions: int | None = None, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Fill nulls linearly in row *position* along ``order``.

    ``v = v0 + (v1 - v0) * (p - p0) / (p1 - p0)`` between the nearest
    non-null neighbours; leading nulls stay null, trailing nulls take the
    last value; columns are independent. Adds the position column ``pos``.
    """
    order, cols = list(order or time_order()), list(cols)
    ranged = sorted_by_range(df.withColumns({c: F.col(c).cast("double") for c in cols}), order, partitions)
    more = [T.StructField(f"_{name}_{c}", T.DoubleType() if name.endswith("v") else T.LongType())
            for c in cols for name in ("prev_p", "prev_v", "next_p", "next_v", "gap", "closes")]
    local = cut_lineage(ranged.mapInArrow(_neighbours(cols, window_rows), T.StructType([*ranged.schema.fields, *more])), "ordered")
    # per partition: row count, first and last non-null (place, value)
    extras = []
    for c in cols:
        mark = F.when(F.col(c).isNotNull(), F.struct(place_of().alias("p"), F.col(c).alias("v")))
        extras += [F.min(mark).alias(f"_first_{c}"), F.max(mark).alias(f"_last_{c}")]
    offs = offsets(local, None, extras)
    left = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    right = Window.orderBy(PID).rowsBetween(1, Window.unboundedFollowing)

    def glob(s: str) -> Column:
        return F.when(F.col(s).isNotNull(), F.struct((F.col(s).p + F.col("_off")).alias("p"),
                                                     F.col(s).v.alias("v")))

    carries = {}
    for c in cols:
        carries[f"_cl_{c}"] = F.last(glob(f"_last_{c}"), ignorenulls=True).over(left)
        carries[f"_cr_{c}"] = F.first(glob(f"_first_{c}"), ignorenulls=True).over(right)
    offs = offs.withColumns(carries).select(PID, "_off", *carries.keys())

    out = _with_gaps_closed(local, cols).withColumn(PID, part_of()).join(F.broadcast(offs), PID).withColumn(pos, F.col("_off") + place_of())
    filled = {}
    for c in cols:
        prev_p = F.coalesce(F.col(f"_prev_p_{c}") + F.col("_off"), F.col(f"_cl_{c}").p)
        prev_v = F.coalesce(F.col(f"_prev_v_{c}"), F.col(f"_cl_{c}").v)
        next_p = F.coalesce(F.col(f"_next_p_{c}") + F.col("_off"), F.col(f"_cr_{c}").p)
        next_v = F.coalesce(F.col(f"_next_v_{c}"), F.col(f"_cr_{c}").v)
        frac = (F.col(pos) - prev_p).cast("double") / (next_p - prev_p).cast("double")
        filled[c] = (F.when(F.col(c).isNotNull(), F.col(c))
                     .when(prev_v.isNull(), F.lit(None).cast("double"))
                     .when(next_v.isNull(), prev_v)
                     .otherwise(prev_v + (next_v - prev_v) * frac))
    return out.withColumns(filled).select(*df.columns, pos)


def distinct_features(df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """Distinct feature rows (nulls compare equal). Partial aggregation per
    partition removes repeats before the shuffle."""
    return df.select(*cols).distinct()


def dedupe_keep_first(df: DataFrame, cols: Sequence[str] = FEATURES, pos: str = "pos",
                      carry: Sequence[str] = ("year",)) -> DataFrame:
    """Drop duplicate feature rows, keeping the carried columns of the first
    row in position order: ``min_by`` in a hash aggregate, no full-row window."""
    aggs = [F.min_by(F.col(c), F.col(pos)).alias(c) for c in carry]
    return df.groupBy(*cols).agg(F.min(pos).alias(pos), *aggs)


def validation_tail(df: DataFrame, fraction: float = 0.1, pos: str = "pos", gaps: bool = False) -> DataFrame:
    """Flag the last ``fraction`` of rows in position order as validation.

    The split point ``floor((1 - fraction) * n)`` comes from a scalar
    subquery over the row count. With ``gaps`` the positions are not dense
    (rows have been dropped since): the position of the last training row is
    then looked up by counting passes when called (see ``selection``)."""
    if gaps:
        from .selection import Key, first_rows
        n_train = math.floor(float(df.count()) * (1.0 - fraction))
        first = first_rows(df, [Key(F.col(pos))], n_train)[1]
        if first is None:  # rows with the position at the split: number them all
            ranked = with_position(df, [F.col(pos)], pos="_r")
            return ranked.withColumn("is_validation", (F.col("_r") >= n_train).cast("int")).drop("_r")
        return df.withColumn("is_validation", (~F.coalesce(first, F.lit(False))).cast("int"))
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    cut = F.floor(n.cast("double") * F.lit(1.0 - fraction))
    return df.withColumn("is_validation", (F.col(pos) >= cut).cast("int"))
