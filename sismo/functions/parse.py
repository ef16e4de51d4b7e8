"""Column-level coercions (text -> typed), all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DATE_REWRITES


def parse_datetime_coerce(c: Column, rewrites=DATE_REWRITES) -> Column:
    """Mixed-format parse; a value that is no date becomes null.

    The date part is first rewritten to year-month-day, then cast to
    ``timestamp_ntz``: any number of time fields and fraction digits, ``T``
    or a space, and a zone suffix (dropped) are accepted, and the wall-clock
    value never passes through the session's time zone."""
    text = F.trim(c)
    for pattern, order in rewrites:
        text = F.regexp_replace(text, pattern, order)
    return text.try_cast("timestamp_ntz")


def parse_datetime_strict(c: Column, rewrites=DATE_REWRITES) -> Column:
    """Like :func:`parse_datetime_coerce` but a non-null value that is no
    date fails the query (the whole load aborts)."""
    parsed = parse_datetime_coerce(c, rewrites)
    return F.when(c.isNotNull() & parsed.isNull(),
                  F.raise_error(F.concat(F.lit("unparseable datetime: "), c))
                  .cast("timestamp_ntz")).otherwise(parsed)


def nan_to_null(c: Column) -> Column:
    """Aggregates in the reference skip NaN; Spark's propagate it."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_numeric_coerce(c: Column) -> Column:
    """Text -> double, unparseable -> null, NaN -> null."""
    return nan_to_null(c.try_cast("double"))
