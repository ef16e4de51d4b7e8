"""Top-k and seeded exact-size samples.

A small k is an ``orderBy(...).limit(k)`` that Spark plans as
``TakeOrderedAndProject``. Thousands of markers or sampled rows would send k
rows of every partition into one merge, so these look up the k-th row's key
(radix refinement, see ``selection``) and keep rows up to it: a map-only filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SEED
from .selection import Key, first_rows


def top_k(df: DataFrame, by: str, k: int = 10, tie: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the largest ``by`` (ties by ``tie`` ascending)."""
    return df.orderBy(F.col(by).desc(), *tie).limit(k)


def top_magnitude_markers(df: DataFrame, cap: int, tie: str = "event_id") -> DataFrame:
    """The ``cap`` rows of largest magnitude (nulls last, ties keep the
    earlier row); all rows when there are no more. Counting passes run when
    called; the result is lazy."""
    return first_rows(df, [Key(F.col("magnitude"), descending=True, nulls_last=True), Key(F.col(tie))], cap)[0]


def sample_key(id_col: str = "event_id", seed: int = SEED):
    """Seeded pseudo-random sort key: md5 of ``id || seed`` (same in SQL)."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def hash_order(md5: Column) -> list[Key]:
    """The order of md5 texts as integers of 60, 60 and 8 bits."""
    return [Key(F.conv(F.substring(md5, a, n), 16, 10).cast("long")) for a, n in ((1, 15), (16, 15), (31, 2))]


def sample_exact_n(df: DataFrame, n: int, seed: int = SEED, id_col: str = "event_id") -> DataFrame:
    """Uniform sample of exactly ``min(n, rows)`` rows without replacement:
    the ``n`` smallest seeded md5 keys (null ids first)."""
    return first_rows(df, [*hash_order(sample_key(id_col, seed)), Key(F.col(id_col))], n)[0]


def last_n_years(yearly: DataFrame, n: int = 5, year: str = "year") -> DataFrame:
    return yearly.orderBy(F.col(year).desc()).limit(n)
