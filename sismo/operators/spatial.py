"""Spatial cells: aggregates, hotspots, heat weights, lattice, bounds.

Cell keys are doubles on the ``bin_size`` lattice built by ``rint`` so they
group exactly. Every cell aggregate is a single partial+final hash
aggregation: map-side combine collapses each partition to at most one row
per cell before the shuffle, so a hot cell never reaches one task whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import cell_of
from ..schema import (BIN_SIZE, DEFAULT_BOUNDS_MAIN, OTHER_CENTER_SPAN, PAD_CELLS_MAIN,
                      TARGET_YEAR, TOP_K, W_COUNT, W_MAG)


def with_cells(df: DataFrame, bin_size: float = BIN_SIZE) -> DataFrame:
    """``cell_id``: add ``lat_bin, lon_bin`` (rows with a null coordinate get
    null cells)."""
    return df.withColumns({"lat_bin": cell_of("latitude", bin_size),
                           "lon_bin": cell_of("longitude", bin_size)})


def cell_aggregate(df: DataFrame, bin_size: float = BIN_SIZE) -> DataFrame:
    """Per cell: ``count`` of non-null magnitudes and ``mean_mag``.

    Rows whose cell key is null are dropped, as a group-by on NaN keys does."""
    cells = with_cells(df.select("latitude", "longitude", "magnitude"), bin_size)
    return (cells.where(F.col("lat_bin").isNotNull() & F.col("lon_bin").isNotNull())
            .groupBy("lat_bin", "lon_bin")
            .agg(F.count("magnitude").alias("count"), F.avg("magnitude").alias("mean_mag")))


def _hotspot_row(cells: DataFrame, count_col: str, hist_col: str, target_year: int) -> DataFrame:
    return cells.select(
        F.col("lat_bin").alias("lat"), F.col("lon_bin").alias("lon"),
        F.col(count_col).cast("long").alias("count"),
        F.col(hist_col).cast("long").alias("historical_count"),
        F.col("mean_mag").alias("mag"),
        F.lit(target_year).cast("int").alias("year"),
        F.lit(None).cast("int").alias("month"))


def hotspots_frequency(df: DataFrame, bin_size: float = BIN_SIZE, top_k: int = TOP_K,
                       target_year: int = TARGET_YEAR) -> DataFrame:
    """Top-k cells by event count, stamped with the target year.

    Ties are broken by (lat, lon) ascending so the result is deterministic.
    Top-k is a ``TakeOrderedAndProject``: each partition keeps k rows."""
    cells = cell_aggregate(df, bin_size)
    ranked = cells.orderBy(F.col("count").desc(), "lat_bin", "lon_bin").limit(top_k)
    return _hotspot_row(ranked, "count", "count", target_year)


def heat_weights(df: DataFrame, bin_size: float = BIN_SIZE,
                 w_count: float = W_COUNT, w_mag: float = W_MAG) -> DataFrame:
    """Per cell ``weight = w_count*count/max(max_count,1) + w_mag*mean_mag/max(mean_mag)``.

    The two maxima are scalar subqueries over the cell aggregate (one small
    job, inlined as literals) — no window over an unpartitioned frame and no
    join with a one-row frame."""
    cells = cell_aggregate(df, bin_size)
    maxima = cells.agg(F.greatest(F.max("count"), F.lit(1)).cast("double").alias("mc"))
    max_mag = cells.agg(F.max("mean_mag").alias("mm"))
    # try_divide: an all-zero magnitude column gives null, not a query error
    weight = (F.lit(w_count) * (F.col("count") / maxima.scalar())
              + F.lit(w_mag) * F.try_divide(F.col("mean_mag"), max_mag.scalar()))
    return cells.select("lat_bin", "lon_bin", weight.alias("weight"))


def map_bounds(points: DataFrame, lat: str = "latitude", lon: str = "longitude",
               bin_size: float = BIN_SIZE, pad_cells: int = PAD_CELLS_MAIN,
               default=DEFAULT_BOUNDS_MAIN, center: tuple[float, float] | None = None,
               span: float = OTHER_CENTER_SPAN) -> DataFrame:
    """1 row: ``min_lat, max_lat, min_lon, max_lon`` padded by ``pad_cells``
    cells; the default box when there are no points — or, when ``center``
    is given, ``center +- span`` degrees (the hotspot-map variant uses
    ``pad_cells=3`` and the map centre)."""
    if center is not None:
        default = (center[0] - span, center[0] + span, center[1] - span, center[1] + span)
    pad = float(bin_size) * pad_cells
    d_lat0, d_lat1, d_lon0, d_lon1 = (float(v) for v in default)
    agg = points.agg(F.min(lat).alias("a"), F.max(lat).alias("b"),
                     F.min(lon).alias("c"), F.max(lon).alias("d"))
    return agg.select(
        F.coalesce(F.col("a") - F.lit(pad), F.lit(d_lat0)).alias("min_lat"),
        F.coalesce(F.col("b") + F.lit(pad), F.lit(d_lat1)).alias("max_lat"),
        F.coalesce(F.col("c") - F.lit(pad), F.lit(d_lon0)).alias("min_lon"),
        F.coalesce(F.col("d") + F.lit(pad), F.lit(d_lon1)).alias("max_lon"))


def map_center(df: DataFrame, by: str = "year") -> DataFrame:
    """Mean latitude/longitude per group."""
    return df.groupBy(by).agg(F.avg("latitude").alias("center_lat"),
                              F.avg("longitude").alias("center_lon"))


def cell_lattice(df: DataFrame, bin_size: float = BIN_SIZE, pad_cells: int = PAD_CELLS_MAIN,
                 fanout: int = 64) -> DataFrame:
    """All cells inside the padded bounds of ``df``, with their event count
    (0 for empty cells).

    The lattice is generated (two nested ``explode(sequence)``), not joined:
    its size is fixed by the bounds and ``bin_size``, never by the row count.
    The counts come from ``cell_aggregate`` by an equi-join on the cell key."""
    b = float(bin_size)
    bounds = map_bounds(df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()),
                        bin_size=b, pad_cells=pad_cells)
    idx = lambda c: F.rint(F.col(c) / F.lit(b)).cast("long")
    lat_rows = (bounds.select(F.explode(F.sequence(idx("min_lat"), idx("max_lat"))).alias("lat_i"),
                              idx("min_lon").alias("lon_lo"), idx("max_lon").alias("lon_hi"))
                .repartition(fanout))
    lattice = (lat_rows.select("lat_i", F.explode(F.sequence("lon_lo", "lon_hi")).alias("lon_i"))
               .select((F.col("lat_i") * F.lit(b) + F.lit(0.0)).alias("lat_bin"),
                       (F.col("lon_i") * F.lit(b) + F.lit(0.0)).alias("lon_bin")))
    counts = cell_aggregate(df, b).select("lat_bin", "lon_bin", "count")
    return (lattice.join(counts, ["lat_bin", "lon_bin"], "left")
            .select("lat_bin", "lon_bin", F.coalesce("count", F.lit(0).cast("long")).alias("count")))


def hotspots_for_year(points: DataFrame, year: int | None) -> DataFrame:
    """Points stamped with ``year`` (all points when ``year`` is None)."""
    return points if year is None else points.where(F.col("year") == F.lit(year))
