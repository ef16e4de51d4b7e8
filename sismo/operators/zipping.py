"""Positional concat: two stored tables side by side, row by row.

Both folders are read in stored order (``sources.positions``). Positions are cut
at common boundaries every ``RANGE_ROWS`` rows; a range's rows of both sides meet
in one task and are put side by side by their place in the range. Nothing is
sorted globally and no task holds more than two ranges, whatever the file
layouts of the two sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.positions import parquet_positions

RANGE_ROWS = 1 << 16
RANGE, AT = "_range", "_at"


def _ranged(scan: DataFrame, rows: int) -> tuple[DataFrame, int]:
    placed, n = parquet_positions(scan, "_pos")
    pos = F.col("_pos")
    return placed.withColumns({RANGE: F.floor(pos / F.lit(rows)).cast("long"), AT: pos % F.lit(rows)}).drop("_pos"), n


def _in_place(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(table.column(AT).to_numpy()))).drop_columns([RANGE, AT])


def zip_stored(spark: SparkSession, left: str, right: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Row i of the Parquet folder ``left`` beside row i of ``right``. Unequal
    lengths or a column name on both sides raise ``ValueError``; two empty
    tables give an empty one. The count passes run when called."""
    a, b = spark.read.parquet(left), spark.read.parquet(right)
    both = [c for c in a.columns if c in b.columns]
    if both:
        raise ValueError(f"columns on both sides: {both}")
    (ra, na), (rb, nb) = _ranged(a, range_rows), _ranged(b, range_rows)
    if na != nb:
        raise ValueError(f"{left} has {na} rows, {right} has {nb}")

    def side_by_side(x: pa.Table, y: pa.Table) -> pa.Table:
        x, y = _in_place(x), _in_place(y)
        return pa.Table.from_arrays([*x.columns, *y.columns], names=[*x.column_names, *y.column_names])

    schema = T.StructType([*a.schema.fields, *b.schema.fields])
    return ra.groupBy(RANGE).cogroup(rb.groupBy(RANGE)).applyInArrow(side_by_side, schema)
