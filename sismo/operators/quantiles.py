"""Exact quantiles by order statistics, without gathering a group's values.

The two order statistics around ``p * (n - 1)`` of a group come from radix
refinement (``selection``): a few passes of counts, no exchange of values.
Between them the result is linear (``lo + (hi - lo) * frac``, the
``quantile_cont`` / numpy "linear" definition).

With more groups than ``selection.STATES`` ranks allow, the values are counted
(one row per group and distinct value) and put in order by range partitions
(one exchange, see ``ordering``); running counts then tell which ranks each
value takes. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .ordering import PID, offsets, part_of, sorted_by_range
from .selection import order_statistics


def qname(p: float) -> str:
    return "q_" + repr(float(p)).replace(".", "_").replace("-", "m")


def _running(batches):
    """Adds ``_end``: the running sum of ``_w`` in the partition."""
    total = 0
    for batch in batches:
        end = total + np.cumsum(batch.column(batch.schema.get_field_index("_w")).to_numpy())
        total = int(end[-1]) if len(end) else total
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(end, pa.int64())], names=[*batch.schema.names, "_end"])


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
                    partitions: int | None = None) -> DataFrame:
    """One row per group: ``*by, n, q_<p>...`` (null and NaN ignored; without
    ``by`` one row even for empty input). Runs jobs when called."""
    by = list(by)
    found = order_statistics(df, [col], probs, by)
    if found is None:
        return sorted_quantiles(df, col, probs, by, partitions)
    rows = [(*r.group, r.n, *r.quantiles) for r in found]
    if not by and not rows:
        rows = [(0, *[None] * len(probs))]
    schema = T.StructType([*(T.StructField(b, df.schema[b].dataType) for b in by), T.StructField("n", T.LongType()),
                           *(T.StructField(qname(p), T.DoubleType()) for p in probs)])
    return df.sparkSession.createDataFrame(rows, schema)


def sorted_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
                     partitions: int | None = None) -> DataFrame:
    """The same rows for any number of groups, over distinct values in order.
    Runs one write job when called."""
    by = list(by)
    vals = df.select(*by, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    seen = vals.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_w"))
    ranged = sorted_by_range(seen, [*(F.col(b).asc() for b in by), F.col("_v").asc()], partitions)
    local = cut_lineage(ranged.mapInArrow(_running, T.StructType([*ranged.schema.fields, T.StructField("_end", T.LongType())])), "values")
    offs = offsets(local, F.sum("_w")).select(PID, "_off")
    ranked = (local.withColumn(PID, part_of()).join(F.broadcast(offs), PID)  # a row per partition
              .select(*by, "_v", (F.col("_off") + F.col("_end") - F.col("_w")).alias("_from"), (F.col("_off") + F.col("_end")).alias("_to")))
    stats = ranked.groupBy(*by).agg(F.min("_from").alias("_s"), F.sum(F.col("_to") - F.col("_from")).alias("n"))
    start, n = F.col("_s"), F.col("n")
    rank = {p: (n - 1).cast("double") * F.lit(float(p)) for p in probs}
    if by:  # null groups are groups too
        on = reduce(lambda a, b: a & b, [F.col(f"r.{b}").eqNullSafe(F.col(f"s.{b}")) for b in by])
        joined = ranked.alias("r").join(stats.alias("s"), on).select(*[F.col(f"r.{b}").alias(b) for b in by], "_v", "_from", "_to", "_s", "n")
    else:
        joined = ranked.withColumns({"_s": F.lit(0), "n": stats.select("n").scalar()})
    aggs = []
    for i, p in enumerate(probs):
        for side, at in (("lo", F.floor(rank[p])), ("hi", F.ceil(rank[p]))):
            hit = (F.col("_from") <= start + at) & (start + at < F.col("_to"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{i}"))
    picked = joined.groupBy(*by).agg(F.max("n").alias("n"), *aggs)
    out = []
    for i, p in enumerate(probs):
        lo, hi, d = F.col(f"_lo{i}"), F.col(f"_hi{i}"), rank[p] - F.floor(rank[p])
        out.append(F.when(d == 0, lo).otherwise(lo + (hi - lo) * d).alias(qname(p)))
    return picked.select(*by, F.coalesce("n", F.lit(0)).alias("n") if not by else "n", *out)
