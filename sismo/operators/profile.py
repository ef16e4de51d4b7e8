"""Profiling and quality: schema, nulls, describe, preview, range checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RANGE_CHECKS
from .selection import order_statistics

NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint")


def schema_profile(df: DataFrame) -> DataFrame:
    """``column, dtype, non_null, position`` — one aggregate pass, then unpivot."""
    cols = df.columns
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in cols])
    long = counts.unpivot([], cols, "column", "non_null")
    dtypes = F.create_map(*[x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))])
    order = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    return long.select("column", dtypes[F.col("column")].alias("dtype"),
                       F.col("non_null").cast("long").alias("non_null"),
                       order[F.col("column")].cast("int").alias("position"))


def null_counts(df: DataFrame) -> DataFrame:
    """``column, null_count`` (NaN counts as null for floating columns)."""
    dt = dict(df.dtypes)

    def is_null(c):
        col = F.col(c)
        return (col.isNull() | F.isnan(col)) if dt[c] in ("double", "float") else col.isNull()

    counts = df.agg(*[F.count_if(is_null(c)).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "null_count").select(
        "column", F.col("null_count").cast("long").alias("null_count"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC]


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: count, mean, std (sample), min, 25/50/75 %, max.

    Moments come from one aggregate pass; quartiles are exact (linear
    interpolation between order statistics) from :func:`order_statistics`:
    all columns in the same few counting passes, no exchange of values."""
    cols = list(cols or numeric_columns(df))
    moments = df.agg(*[F.struct(F.count(c).cast("long").alias("count"),
                                F.avg(F.col(c).cast("double")).alias("mean"),
                                F.stddev_samp(F.col(c).cast("double")).alias("std"),
                                F.min(F.col(c).cast("double")).alias("min"),
                                F.max(F.col(c).cast("double")).alias("max")).alias(c)
                       for c in cols])
    moments = moments.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c + ".*")) for c in cols])))
    found = order_statistics(df, cols, (0.25, 0.5, 0.75))
    quarts = df.sparkSession.createDataFrame([(cols[r.column], *r.quantiles) for r in found], "column string, p25 double, p50 double, p75 double")
    return (moments.join(quarts, "column", "left")  # both a row per column
            .select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"))


def preview(df: DataFrame, n: int = 5, order: Sequence[str] = ("event_id",)) -> DataFrame:
    """First ``n`` rows in a stated order (``TakeOrderedAndProject``)."""
    return df.orderBy(*order).limit(n)


def input_range_check(df: DataFrame, checks=RANGE_CHECKS) -> DataFrame:
    """Add ``is_valid`` and ``reasons`` (array of failed checks) per record.

    A null value fails its check."""
    fails = [F.when(~F.coalesce(F.col(c).between(lo, hi), F.lit(False)),
                    F.lit(f"{c} outside [{lo:g}, {hi:g}]")) for c, lo, hi in checks]
    reasons = F.filter(F.array(*fails), lambda x: x.isNotNull())
    return df.withColumns({"reasons": reasons, "is_valid": (F.size(reasons) == 0).cast("int")})
