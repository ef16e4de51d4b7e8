"""Registered queries: catalogue, cleaning, filters, cells and hotspots."""

from __future__ import annotations


from ..operators import filters as flt
from ..operators import spatial as sp
from ..sources import fixtures as fx
from ..functions.cells import cell_sql
from .registry import register
from .sqlkit import R6, build, cte, r6

# ---------------------------------------------------------------------------
# Shared oracle CTEs
# ---------------------------------------------------------------------------
cte("clean", """clean AS (
  SELECT *, CAST(year(datetime) AS INTEGER) AS year, CAST(month(datetime) AS INTEGER) AS month
  FROM cat
  WHERE datetime IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL
    AND magnitude IS NOT NULL AND NOT isnan(magnitude))""", ("cat",))
cte("cat_ym", """cat_ym AS (
  SELECT *, CAST(year(datetime) AS INTEGER) AS year, CAST(month(datetime) AS INTEGER) AS month
  FROM cat)""", ("cat",))
cte("cells", f"""cells AS (
  SELECT {cell_sql('latitude')} AS lat_bin, {cell_sql('longitude')} AS lon_bin,
         CAST(count(magnitude) AS BIGINT) AS count, avg(magnitude) AS mean_mag
  FROM clean WHERE latitude IS NOT NULL AND longitude IS NOT NULL
  GROUP BY 1, 2)""", ("clean",))


def cat(spark, sf):
    return fx.catalog(spark, sf)


def clean(spark, sf):
    return flt.prediction_clean(fx.catalog(spark, sf))


def cat_ym(spark, sf):
    return flt.add_year_month(fx.catalog(spark, sf))


# ---------------------------------------------------------------------------
# 2.1 / 2.3 cleaning
# ---------------------------------------------------------------------------
@register("prediction_clean", build("SELECT * FROM clean", "clean"))
def q_prediction_clean(spark, sf):
    return clean(spark, sf)


@register("add_year_month", build("SELECT * FROM cat_ym", "cat_ym"))
def q_add_year_month(spark, sf):
    return cat_ym(spark, sf)


# ---------------------------------------------------------------------------
# 2.11 / 2.6 spatial
# ---------------------------------------------------------------------------
@register("cell_id", build(f"""SELECT event_id, {cell_sql('latitude')} AS lat_bin,
  {cell_sql('longitude')} AS lon_bin FROM cat""", "cat"))
def q_cell_id(spark, sf):
    return sp.with_cells(cat(spark, sf)).select("event_id", "lat_bin", "lon_bin")


@register("cell_aggregate", build(
    f"SELECT lat_bin, lon_bin, count, {R6('mean_mag')} AS mean_mag FROM cells", "cells"),
    headline=True)
def q_cell_aggregate(spark, sf):
    c = sp.cell_aggregate(clean(spark, sf))
    return c.select("lat_bin", "lon_bin", "count", r6("mean_mag").alias("mean_mag"))


HOTSPOT_FREQ_BODY = f"""SELECT lat_bin AS lat, lon_bin AS lon, count, count AS historical_count,
  {R6('mean_mag')} AS mag, CAST(2026 AS INTEGER) AS year, CAST(NULL AS INTEGER) AS month
FROM cells ORDER BY count DESC, lat_bin, lon_bin LIMIT 15"""
HOTSPOT_FREQ_SQL = build(HOTSPOT_FREQ_BODY, "cells")


@register("hotspots_frequency", HOTSPOT_FREQ_SQL, headline=True)
def q_hotspots_frequency(spark, sf):
    return sp.hotspots_frequency(clean(spark, sf)).withColumn("mag", r6("mag"))


@register("heat_weights", build(f"""SELECT lat_bin, lon_bin,
  {R6("0.8 * (count / greatest((SELECT max(count) FROM cells), 1)) + 0.2 * (mean_mag / (SELECT max(mean_mag) FROM cells))")} AS weight
FROM cells""", "cells"))
def q_heat_weights(spark, sf):
    return sp.heat_weights(clean(spark, sf)).withColumn("weight", r6("weight"))


@register("map_bounds", build("""SELECT
  coalesce(min(latitude) - 2.5, -11.0) AS min_lat, coalesce(max(latitude) + 2.5, 6.0) AS max_lat,
  coalesce(min(longitude) - 2.5, 95.0) AS min_lon, coalesce(max(longitude) + 2.5, 141.0) AS max_lon
FROM clean""", "clean"))
def q_map_bounds(spark, sf):
    return sp.map_bounds(clean(spark, sf))


@register("map_center", build(f"""SELECT year, {R6('avg(latitude)')} AS center_lat,
  {R6('avg(longitude)')} AS center_lon FROM clean GROUP BY year""", "clean"))
def q_map_center(spark, sf):
    m = sp.map_center(clean(spark, sf))
    return m.select("year", r6("center_lat").alias("center_lat"), r6("center_lon").alias("center_lon"))


cte("lattice", """b AS (SELECT min(latitude) - 2.5 AS a0, max(latitude) + 2.5 AS a1,
               min(longitude) - 2.5 AS o0, max(longitude) + 2.5 AS o1 FROM clean),
lat_i AS (SELECT unnest(range(CAST(round_even(a0 / 0.5, 0) AS BIGINT),
                              CAST(round_even(a1 / 0.5, 0) AS BIGINT) + 1)) AS i FROM b),
lon_i AS (SELECT unnest(range(CAST(round_even(o0 / 0.5, 0) AS BIGINT),
                              CAST(round_even(o1 / 0.5, 0) AS BIGINT) + 1)) AS j FROM b),
lattice AS (SELECT lat_i.i * 0.5 + 0.0 AS lat_bin, lon_i.j * 0.5 + 0.0 AS lon_bin
            FROM lat_i, lon_i)""", ("clean",))


@register("cell_lattice", build("""SELECT l.lat_bin, l.lon_bin, coalesce(c.count, CAST(0 AS BIGINT)) AS count
FROM lattice l LEFT JOIN cells c ON l.lat_bin = c.lat_bin AND l.lon_bin = c.lon_bin""",
    "cells", "lattice"))
def q_cell_lattice(spark, sf):
    return sp.cell_lattice(clean(spark, sf))


@register("hotspots_for_year",
          build(f"SELECT * FROM ({HOTSPOT_FREQ_BODY}) WHERE year = 2026", "cells"))
def q_hotspots_for_year(spark, sf):
    return sp.hotspots_for_year(sp.hotspots_frequency(clean(spark, sf)), 2026).withColumn("mag", r6("mag"))
