"""Spatial cell keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BIN_SIZE


def cell_of(c: Column | str, bin_size: float = BIN_SIZE) -> Column:
    """Snap a coordinate to the nearest multiple of ``bin_size``.

    Half-to-even rounding (``rint``) like numpy; ``+ 0.0`` turns -0.0 into
    0.0 so equal cells group and hash equally."""
    col = F.col(c) if isinstance(c, str) else c
    return F.rint(col / F.lit(float(bin_size))) * F.lit(float(bin_size)) + F.lit(0.0)


def cell_sql(c: str, bin_size: float = BIN_SIZE) -> str:
    """DuckDB twin of :func:`cell_of`."""
    b = repr(float(bin_size))
    return f"(round_even({c} / {b}, 0) * {b} + 0.0)"
