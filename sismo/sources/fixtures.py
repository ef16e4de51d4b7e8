"""Event catalogues derived from the driver's tables, with DuckDB twins.

The reference reads one CSV of earthquake events that is not shipped; the
catalogue used here is derived from ``events`` so its work grows with the
table: time is spread over 2008-2025, nulls and repeated feature rows are
injected. The Spark frame and the DuckDB SQL below produce identical values
for every row (no rounding inside, the engines round differently).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import parse_datetime_coerce, to_numeric_coerce

EVENTS_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                 "value double, props string")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's ``events`` table with its declared schema (no footer
    scan for schema inference; column pruning still reads only what the
    plan needs)."""
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def catalog_from_events(events: DataFrame) -> DataFrame:
    """``event_id, datetime, magnitude, depth, latitude, longitude, location``.

    Written as SQL expressions (one parse per column instead of hundreds of
    client calls to assemble the same expression trees)."""
    base = events.selectExpr(
        "event_id",
        "CASE WHEN event_id % 211 = 0 THEN NULL"
        " ELSE ts + make_interval(0, 23 - CAST(event_id * 5 % 216 AS INT)) END AS datetime",
        "CASE WHEN event_id % 37 = 0 THEN NULL ELSE CAST(2.0 AS DOUBLE) + value / CAST(100 AS DOUBLE) END"
        " AS magnitude",
        "CASE WHEN event_id % 41 = 0 THEN NULL"
        " ELSE CAST(5 AS DOUBLE) + CAST(6 AS DOUBLE) * CAST(CAST(get_json_object(props, '$.k') AS INT) AS DOUBLE)"
        " END AS depth",
        "CASE WHEN event_id % 113 = 0 THEN NULL"
        " ELSE CAST(-11 AS DOUBLE) + CAST(user_id * 37 % 1700 AS DOUBLE) / CAST(100 AS DOUBLE)"
        " + CAST(event_id * 13 % 97 - 48 AS DOUBLE) / CAST(200 AS DOUBLE) END AS latitude",
        "CASE WHEN event_id % 113 = 0 THEN NULL"
        " ELSE CAST(95 AS DOUBLE) + CAST(user_id * 91 % 4600 AS DOUBLE) / CAST(100 AS DOUBLE)"
        " + CAST(event_id * 29 % 89 - 44 AS DOUBLE) / CAST(200 AS DOUBLE) END AS longitude",
        "event_type AS location")
    dups = base.where("event_id % 53 = 0").selectExpr(
        "-event_id - 1 AS event_id", "datetime + INTERVAL 1 DAY AS datetime",
        "magnitude", "depth", "latitude", "longitude", "location")
    return base.unionByName(dups)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_from_events(_events(spark, sf_dir))


def _text_datetime(junk: bool):
    eid = F.col("event_id")
    fmt = (F.when(eid % 3 == 0, F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))
           .when(eid % 3 == 1, F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSS"))
           .otherwise(F.date_format("datetime", "yyyy/MM/dd HH:mm")))
    if junk:
        return F.when(eid % 307 == 0, F.lit("not-a-date")).otherwise(fmt)
    return fmt


def catalog_text(spark: SparkSession, sf_dir: str, junk: bool = True) -> DataFrame:
    """Dirty-text variant: datetime in three formats (plus ``not-a-date`` when
    ``junk``) and magnitude as text (``N/A`` when ``junk``)."""
    cat = catalog(spark, sf_dir)
    eid = F.col("event_id")
    mag = F.col("magnitude").cast("string")
    if junk:
        mag = F.when(eid % 101 == 0, F.lit("N/A")).otherwise(mag)
    return cat.select("event_id", _text_datetime(junk).alias("datetime"), mag.alias("magnitude"),
                      "depth", "latitude", "longitude", "location")


def catalog_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty-text catalogue coerced back to typed columns."""
    raw = catalog_text(spark, sf_dir, junk=True)
    return raw.select("event_id", parse_datetime_coerce(F.col("datetime")).alias("datetime"),
                      to_numeric_coerce(F.col("magnitude")).alias("magnitude"),
                      "depth", "latitude", "longitude", "location")


# ---------------------------------------------------------------------------
# DuckDB twins (oracle side). Views ``events`` etc. are registered by the caller.
# ---------------------------------------------------------------------------
CAT_SQL = """
cat_base AS (
  SELECT event_id,
    CASE WHEN event_id % 211 = 0 THEN NULL
         ELSE ts + to_months(23 - CAST(event_id * 5 % 216 AS INTEGER)) END AS datetime,
    CASE WHEN event_id % 37 = 0 THEN NULL
         ELSE CAST(2.0 AS DOUBLE) + value / CAST(100 AS DOUBLE) END AS magnitude,
    CASE WHEN event_id % 41 = 0 THEN NULL
         ELSE CAST(5 AS DOUBLE) + CAST(6 AS DOUBLE) * CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) END AS depth,
    CASE WHEN event_id % 113 = 0 THEN NULL
         ELSE CAST(-11 AS DOUBLE) + CAST(user_id * 37 % 1700 AS DOUBLE) / CAST(100 AS DOUBLE)
              + CAST(event_id * 13 % 97 - 48 AS DOUBLE) / CAST(200 AS DOUBLE) END AS latitude,
    CASE WHEN event_id % 113 = 0 THEN NULL
         ELSE CAST(95 AS DOUBLE) + CAST(user_id * 91 % 4600 AS DOUBLE) / CAST(100 AS DOUBLE)
              + CAST(event_id * 29 % 89 - 44 AS DOUBLE) / CAST(200 AS DOUBLE) END AS longitude,
    event_type AS location
  FROM events),
cat AS (
  SELECT * FROM cat_base
  UNION ALL
  SELECT -event_id - 1, datetime + INTERVAL 1 DAY, magnitude, depth, latitude, longitude, location
  FROM cat_base WHERE event_id % 53 = 0)"""

_DT_TEXT_SQL = """CASE WHEN event_id % 3 = 0 THEN strftime(datetime, '%Y-%m-%d %H:%M:%S')
              WHEN event_id % 3 = 1 THEN strftime(datetime, '%Y-%m-%d %H:%M:%S.%g')
              ELSE strftime(datetime, '%Y/%m/%d %H:%M') END"""

CAT_RAW_SQL = f"""
cat_raw AS (
  SELECT event_id,
    CASE WHEN event_id % 307 = 0 THEN 'not-a-date' ELSE {_DT_TEXT_SQL} END AS datetime,
    CASE WHEN event_id % 101 = 0 THEN 'N/A' ELSE CAST(magnitude AS VARCHAR) END AS magnitude,
    depth, latitude, longitude, location
  FROM cat),
cat_clean_text AS (
  SELECT event_id, {_DT_TEXT_SQL} AS datetime, CAST(magnitude AS VARCHAR) AS magnitude,
    depth, latitude, longitude, location
  FROM cat)"""

PARSE_DT_SQL = """coalesce(try_strptime({c}, '%Y-%m-%d %H:%M:%S'),
                try_strptime({c}, '%Y-%m-%d %H:%M:%S.%g'),
                try_strptime({c}, '%Y/%m/%d %H:%M'),
                try_strptime({c}, '%Y-%m-%dT%H:%M:%S'),
                try_strptime({c}, '%Y-%m-%d'))"""

PARSE_NUM_SQL = "CASE WHEN isnan(TRY_CAST({c} AS DOUBLE)) THEN NULL ELSE TRY_CAST({c} AS DOUBLE) END"
