"""Projections, filters and the cleaning chain of the prediction input."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import nan_to_null, parse_datetime_coerce, to_numeric_coerce
from ..schema import FEATURES


def add_year_month(df: DataFrame, ts: str = "datetime") -> DataFrame:
    return df.withColumns({"year": F.year(ts).cast("int"), "month": F.month(ts).cast("int")})


def select_features(df: DataFrame, cols: Iterable[str] = FEATURES, keep: Iterable[str] = ()) -> DataFrame:
    return df.select(*keep, *cols)


def drop_nulls(df: DataFrame, subset: Iterable[str]) -> DataFrame:
    """Drop rows with null (or NaN) in any of ``subset``."""
    subset = list(subset)
    dtypes = dict(df.dtypes)
    fixed = df.withColumns({c: nan_to_null(F.col(c)) for c in subset
                            if dtypes.get(c) in ("double", "float")})
    return fixed.dropna(subset=subset)


def prediction_clean(df: DataFrame) -> DataFrame:
    """Coerce datetime (bad -> dropped), drop null lat/lon/magnitude, coerce
    magnitude to a number (bad -> dropped), add year/month."""
    dtypes = dict(df.dtypes)
    dt = F.col("datetime")
    if dtypes["datetime"] == "string":
        dt = parse_datetime_coerce(dt)
    mag = (to_numeric_coerce(F.col("magnitude")) if dtypes["magnitude"] == "string"
           else nan_to_null(F.col("magnitude")))
    out = (df.withColumn("datetime", dt)
           .where(F.col("datetime").isNotNull())
           .where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
                  & F.col("magnitude").isNotNull())
           .withColumn("magnitude", mag)
           .where(F.col("magnitude").isNotNull()))
    return add_year_month(out)


def filter_year(df: DataFrame, year: int) -> DataFrame:
    return df.where(F.col("year") == F.lit(year))


def filter_year_range(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.where(F.col("year").between(first, last))


def membership_semi_join(df: DataFrame, years: DataFrame, key: str = "year") -> DataFrame:
    """Keep rows whose key is in ``years`` (a DataFrame of chosen keys).

    A left-semi join: broadcast when the key list is small (the optimizer
    decides from its size statistics), sort-merge otherwise."""
    return df.join(years.select(key).distinct(), key, "left_semi")


def explore_filter(df: DataFrame, years=None, mag_range=None, depth_range=None,
                   truncate_bounds: bool = False) -> DataFrame:
    """Years in a set AND magnitude in a range AND depth in a range.

    Null values fail the range tests. Defaults are the data's own bounds
    (scalar subqueries); ``truncate_bounds`` reproduces integer-truncated
    depth slider bounds."""
    out = df
    if years is not None:
        if isinstance(years, DataFrame):
            out = membership_semi_join(out, years)
        else:
            out = out.where(F.col("year").isin([int(y) for y in years]))
    bounds = df.agg(F.min("magnitude").alias("m0"), F.max("magnitude").alias("m1"),
                    F.min("depth").alias("d0"), F.max("depth").alias("d1"))
    if mag_range is None:
        lo, hi = (bounds.select("m0").scalar(), bounds.select("m1").scalar())
    else:
        lo, hi = F.lit(float(mag_range[0])), F.lit(float(mag_range[1]))
    if depth_range is None:
        dlo, dhi = bounds.select("d0").scalar(), bounds.select("d1").scalar()
        if truncate_bounds:
            dlo, dhi = (b.cast("long").cast("double") for b in (dlo, dhi))  # toward zero
    else:
        dlo, dhi = F.lit(float(depth_range[0])), F.lit(float(depth_range[1]))
    return out.where((F.col("magnitude") >= lo) & (F.col("magnitude") <= hi)
                     & (F.col("depth") >= dlo) & (F.col("depth") <= dhi))


def filter_options(df: DataFrame) -> DataFrame:
    """Distinct years (ascending) with the slider bounds on every row."""
    years = df.where(F.col("year").isNotNull()).select("year").distinct()
    b = df.agg(F.min("magnitude").alias("min_mag"), F.max("magnitude").alias("max_mag"),
               F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"))
    return years.select("year", *[b.select(c).scalar().alias(c) for c in b.columns]).orderBy("year")


def column_picker(df: DataFrame, wanted: Iterable[str], default: Iterable[str] = ()) -> DataFrame:
    """Dynamic projection: the wanted columns that exist, else ``default``."""
    cols = [c for c in wanted if c in df.columns] or [c for c in default if c in df.columns]
    return df.select(*cols)


def split_by_flag(df: DataFrame, flag: str = "is_anomaly", value: int = 1) -> DataFrame:
    return df.where(F.col(flag) == F.lit(value))


def filter_cluster(df: DataFrame, label: int, col: str = "cluster_label") -> DataFrame:
    return df.where(F.col(col) == F.lit(label))
