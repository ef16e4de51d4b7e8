"""Registered queries: parsing, profiling, filters, ordering/cleaning,
exploratory aggregates, top-k/sampling and text labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as ps
from ..functions import text as tx
from ..operators import explore as ex
from ..operators import filters as flt
from ..operators import ordering as od
from ..operators import profile as pf
from ..operators import topk as tk
from ..schema import FEATURES, MARKER_CAP
from ..sources import fixtures as fx
from .q_core import cat, cat_ym, clean
from .registry import register
from .sqlkit import R6, build, cte, r6

F4 = list(FEATURES)


def fixed_sql(x: str, dp: int) -> str:
    s = float(10 ** dp)
    return f"printf('%.{dp}f', floor(({x}) * {s} + 0.5) / {s})"


# ---------------------------------------------------------------------------
# Ordering / interpolation CTEs
# ---------------------------------------------------------------------------
cte("ordered", """ordered AS (
  SELECT *, row_number() OVER (ORDER BY datetime ASC NULLS LAST, event_id) - 1 AS pos FROM cat_ym)""",
    ("cat_ym",))


def _interp_cols() -> str:
    win_b = "OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    win_f = "OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    parts = []
    for c in F4:
        parts.append(f"last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {win_b} AS {c}_p0")
        parts.append(f"last_value({c} IGNORE NULLS) {win_b} AS {c}_v0")
        parts.append(f"first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {win_f} AS {c}_p1")
        parts.append(f"first_value({c} IGNORE NULLS) {win_f} AS {c}_v1")
    return ",\n    ".join(parts)


def _interp_select() -> str:
    out = []
    for c in F4:
        out.append(f"""CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_v0 IS NULL THEN NULL
      WHEN {c}_v1 IS NULL THEN {c}_v0
      ELSE {c}_v0 + ({c}_v1 - {c}_v0) * (CAST(pos - {c}_p0 AS DOUBLE) / CAST({c}_p1 - {c}_p0 AS DOUBLE)) END AS {c}""")
    return ",\n  ".join(out)


cte("interp", f"""interp_w AS (
  SELECT *, {_interp_cols()}
  FROM ordered),
interp AS (
  SELECT event_id, datetime, year, month, location, pos,
  {_interp_select()}
  FROM interp_w)""", ("ordered",))


def interp(spark, sf):
    return od.interpolate_linear(cat_ym(spark, sf), F4)


# ---------------------------------------------------------------------------
# 2.1 parsing
# ---------------------------------------------------------------------------
@register("parse_datetime_coerce", build(f"""SELECT event_id, datetime AS datetime_text,
  {fx.PARSE_DT_SQL.format(c='datetime')} AS datetime FROM cat_raw""", "cat_raw"))
def q_parse_coerce(spark, sf):
    raw = fx.catalog_text(spark, sf, junk=True)
    return raw.select("event_id", F.col("datetime").alias("datetime_text"),
                      ps.parse_datetime_coerce(F.col("datetime")).alias("datetime"))


@register("parse_datetime_strict", build(f"""SELECT event_id,
  {fx.PARSE_DT_SQL.format(c='datetime')} AS datetime FROM cat_clean_text""", "cat_raw"))
def q_parse_strict(spark, sf):
    txt = fx.catalog_text(spark, sf, junk=False)
    return txt.select("event_id", ps.parse_datetime_strict(F.col("datetime")).alias("datetime"))


@register("to_numeric_coerce", build(f"""SELECT event_id, magnitude AS magnitude_text,
  {fx.PARSE_NUM_SQL.format(c='magnitude')} AS magnitude FROM cat_raw""", "cat_raw"))
def q_to_numeric(spark, sf):
    raw = fx.catalog_text(spark, sf, junk=True)
    return raw.select("event_id", F.col("magnitude").alias("magnitude_text"),
                      ps.to_numeric_coerce(F.col("magnitude")).alias("magnitude"))


@register("read_catalog_text", build(f"""SELECT event_id, {fx.PARSE_DT_SQL.format(c='datetime')} AS datetime,
  {fx.PARSE_NUM_SQL.format(c='magnitude')} AS magnitude, depth, latitude, longitude, location
FROM cat_raw""", "cat_raw"))
def q_read_catalog_text(spark, sf):
    return fx.catalog_parsed(spark, sf)


# ---------------------------------------------------------------------------
# 2.2 profiling
# ---------------------------------------------------------------------------
_CAT_TYPES = [("event_id", "bigint"), ("datetime", "timestamp_ntz"), ("magnitude", "double"),
              ("depth", "double"), ("latitude", "double"), ("longitude", "double"),
              ("location", "string")]


@register("schema_profile", build(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CAST(count({c}) AS BIGINT) AS non_null, "
    f"CAST({i} AS INTEGER) AS position FROM cat" for i, (c, t) in enumerate(_CAT_TYPES)), "cat"))
def q_schema_profile(spark, sf):
    return pf.schema_profile(cat(spark, sf))


def _isnull_sql(c, t):
    return f"{c} IS NULL OR isnan({c})" if t == "double" else f"{c} IS NULL"


@register("null_counts", build(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count_if({_isnull_sql(c, t)}) AS BIGINT) AS null_count FROM cat"
    for c, t in _CAT_TYPES), "cat"))
def q_null_counts(spark, sf):
    return pf.null_counts(cat(spark, sf))


@register("describe", build(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, {R6(f'avg({c})')} AS mean,
  {R6(f'stddev_samp({c})')} AS std, min({c}) AS min, {R6(f'quantile_cont({c}, 0.25)')} AS p25,
  {R6(f'quantile_cont({c}, 0.5)')} AS p50, {R6(f'quantile_cont({c}, 0.75)')} AS p75, max({c}) AS max
FROM cat""" for c in F4), "cat"))
def q_describe(spark, sf):
    d = pf.describe(cat(spark, sf), F4)
    return d.select("column", "count", *[r6(c).alias(c) if c not in ("min", "max") else F.col(c)
                                         for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@register("preview", build("SELECT * FROM cat ORDER BY event_id LIMIT 5", "cat"))
def q_preview(spark, sf):
    return pf.preview(cat(spark, sf), 5)


def _range_sql() -> str:
    from ..schema import RANGE_CHECKS
    items = ", ".join(f"CASE WHEN NOT coalesce({c} BETWEEN {lo} AND {hi}, false) "
                      f"THEN '{c} outside [{lo:g}, {hi:g}]' END" for c, lo, hi in RANGE_CHECKS)
    lst = f"list_filter([{items}], lambda x: x IS NOT NULL)"
    return f"""SELECT event_id, array_to_string({lst}, '; ') AS reasons,
  CAST(len({lst}) = 0 AS INTEGER) AS is_valid FROM cat"""


@register("input_range_check", build(_range_sql(), "cat"))
def q_input_range_check(spark, sf):
    r = pf.input_range_check(cat(spark, sf))
    return r.select("event_id", F.array_join("reasons", "; ").alias("reasons"), "is_valid")


# ---------------------------------------------------------------------------
# 2.3 projections and filters
# ---------------------------------------------------------------------------
@register("select_features", build(
    "SELECT year, magnitude, depth, latitude, longitude FROM cat_ym", "cat_ym"))
def q_select_features(spark, sf):
    return flt.select_features(cat_ym(spark, sf), F4, keep=("year",))


@register("drop_nulls", build("""SELECT * FROM cat
WHERE datetime IS NOT NULL AND magnitude IS NOT NULL AND NOT isnan(magnitude)
  AND latitude IS NOT NULL AND NOT isnan(latitude)""", "cat"))
def q_drop_nulls(spark, sf):
    return flt.drop_nulls(cat(spark, sf), ["datetime", "magnitude", "latitude"])


@register("filter_year", build("SELECT * FROM clean WHERE year = 2015", "clean"))
def q_filter_year(spark, sf):
    return flt.filter_year(clean(spark, sf), 2015)


@register("filter_year_range", build("SELECT * FROM clean WHERE year BETWEEN 2012 AND 2018", "clean"))
def q_filter_year_range(spark, sf):
    return flt.filter_year_range(clean(spark, sf), 2012, 2018)


@register("explore_filter", build("""SELECT * FROM cat_ym
WHERE year IN (2010, 2011, 2012, 2013, 2014, 2015, 2016, 2017, 2018, 2019)
  AND magnitude >= 2.5 AND magnitude <= 5.0 AND depth >= 10.0 AND depth <= 400.0""", "cat_ym"))
def q_explore_filter(spark, sf):
    return flt.explore_filter(cat_ym(spark, sf), years=range(2010, 2020), mag_range=(2.5, 5.0),
                              depth_range=(10.0, 400.0))


@register("explore_filter_defaults", build("""SELECT * FROM cat_ym
WHERE magnitude >= (SELECT min(magnitude) FROM cat_ym) AND magnitude <= (SELECT max(magnitude) FROM cat_ym)
  AND depth >= (SELECT trunc(min(depth)) FROM cat_ym) AND depth <= (SELECT trunc(max(depth)) FROM cat_ym)""",
    "cat_ym"))
def q_explore_filter_defaults(spark, sf):
    return flt.explore_filter(cat_ym(spark, sf), truncate_bounds=True)


@register("filter_options", build("""SELECT y.year, b.min_mag, b.max_mag, b.min_depth, b.max_depth
FROM (SELECT DISTINCT year FROM cat_ym WHERE year IS NOT NULL) y,
     (SELECT min(magnitude) AS min_mag, max(magnitude) AS max_mag, min(depth) AS min_depth,
             max(depth) AS max_depth FROM cat_ym) b""", "cat_ym"))
def q_filter_options(spark, sf):
    return flt.filter_options(cat_ym(spark, sf))


@register("column_picker", build("SELECT datetime, magnitude, depth, location FROM cat", "cat"))
def q_column_picker(spark, sf):
    return flt.column_picker(cat(spark, sf), ["datetime", "magnitude", "depth", "felt_reports", "location"])


cte("yearly", """yearly AS (
  SELECT year, CAST(count(*) AS BIGINT) AS frequency FROM clean
  WHERE year BETWEEN 2008 AND 2025 GROUP BY year)""", ("clean",))


@register("membership_semi_join", build("""SELECT * FROM clean WHERE year IN (
  SELECT year FROM yearly WHERE frequency > (SELECT avg(frequency) FROM yearly))""", "yearly"))
def q_membership(spark, sf):
    c = clean(spark, sf)
    yc = ex.yearly_counts(c, 2008, 2025)
    busy = yc.where(F.col("frequency") > yc.agg(F.avg("frequency")).scalar())
    return flt.membership_semi_join(c, busy)


# ---------------------------------------------------------------------------
# 2.4 / 2.7 ordering, interpolation, dedup
# ---------------------------------------------------------------------------
@register("sort_by_time", build("SELECT event_id, datetime, pos FROM ordered", "ordered"))
def q_sort_by_time(spark, sf):
    return od.sort_by_time(cat(spark, sf)).select("event_id", "datetime", "pos")


@register("interpolate_linear", build(
    "SELECT event_id, pos, magnitude, depth, latitude, longitude FROM interp", "interp"),
    headline=True)
def q_interpolate(spark, sf):
    return interp(spark, sf).select("event_id", "pos", *F4)


@register("distinct_features", build(
    "SELECT DISTINCT magnitude, depth, latitude, longitude FROM interp", "interp"))
def q_distinct_features(spark, sf):
    return od.distinct_features(interp(spark, sf))


cte("dedup", """dedup AS (
  SELECT magnitude, depth, latitude, longitude, min(pos) AS pos, arg_min(year, pos) AS year
  FROM interp GROUP BY magnitude, depth, latitude, longitude)""", ("interp",))


@register("dedupe_keep_first", build("SELECT * FROM dedup", "dedup"))
def q_dedupe_keep_first(spark, sf):
    return od.dedupe_keep_first(interp(spark, sf))


@register("validation_tail", build("""SELECT event_id, pos,
  CAST(pos >= floor(CAST((SELECT count(*) FROM ordered) AS DOUBLE) * 0.9) AS INTEGER) AS is_validation
FROM ordered""", "ordered"))
def q_validation_tail(spark, sf):
    return od.validation_tail(od.sort_by_time(cat(spark, sf))).select("event_id", "pos", "is_validation")


# ---------------------------------------------------------------------------
# 2.6 exploratory aggregates
# ---------------------------------------------------------------------------
@register("kpi_summary", build(f"""SELECT CAST(count(*) AS BIGINT) AS rows, min(year) AS min_year,
  max(year) AS max_year, {R6('avg(magnitude)')} AS mean_magnitude, {R6('avg(depth)')} AS mean_depth
FROM cat_ym""", "cat_ym"))
def q_kpi(spark, sf):
    k = ex.kpi_summary(cat_ym(spark, sf))
    return k.select("rows", "min_year", "max_year", r6("mean_magnitude").alias("mean_magnitude"),
                    r6("mean_depth").alias("mean_depth"))


@register("yearly_mean_magnitude", build(f"""SELECT year, {R6('avg(magnitude)')} AS mean_magnitude
FROM cat_ym WHERE year IS NOT NULL GROUP BY year""", "cat_ym"))
def q_yearly_mean(spark, sf):
    y = ex.yearly_mean_magnitude(cat_ym(spark, sf))
    return y.select("year", r6("mean_magnitude").alias("mean_magnitude"))


@register("monthly_mean_magnitude", build(f"""SELECT CAST(year(datetime) AS INTEGER) AS year,
  CAST(month(datetime) AS INTEGER) AS month, {R6('avg(magnitude)')} AS mean_magnitude
FROM cat WHERE datetime IS NOT NULL AND magnitude IS NOT NULL GROUP BY 1, 2""", "cat"))
def q_monthly_mean(spark, sf):
    m = ex.monthly_mean_magnitude(cat(spark, sf))
    return m.select("year", "month", r6("mean_magnitude").alias("mean_magnitude"))


@register("yearly_counts", build("SELECT * FROM yearly", "yearly"))
def q_yearly_counts(spark, sf):
    return ex.yearly_counts(clean(spark, sf), 2008, 2025)


cte("ystats", """ystats AS (
  SELECT year, CAST(count(magnitude) AS BIGINT) AS count, min(magnitude) AS min, max(magnitude) AS max,
    avg(magnitude) AS mean, quantile_cont(magnitude, 0.5) AS median
  FROM clean GROUP BY year)""", ("clean",))


@register("year_magnitude_stats", build(
    f"SELECT year, count, min, max, {R6('mean')} AS mean, {R6('median')} AS median FROM ystats",
    "ystats"))
def q_year_stats(spark, sf):
    s = ex.year_magnitude_stats(clean(spark, sf))
    return s.select("year", "count", "min", "max", r6("mean").alias("mean"), r6("median").alias("median"))


@register("skew_label", build(f"""SELECT year, CASE WHEN {R6('mean')} < {R6('median')} THEN 'left'
  WHEN {R6('mean')} > {R6('median')} THEN 'right' ELSE 'symmetric' END AS skew FROM ystats""", "ystats"))
def q_skew_label(spark, sf):
    s = ex.year_magnitude_stats(clean(spark, sf))
    s = s.select("year", r6("mean").alias("mean"), r6("median").alias("median"))
    return ex.skew_label(s).select("year", "skew")


def _hist_sql(col: str, bins: int = 50) -> str:
    return f"""st AS (SELECT min({col}) AS mn0, max({col}) AS mx0, count(*) AS n FROM cat
  WHERE {col} IS NOT NULL AND NOT isnan({col})),
b AS (SELECT CASE WHEN mn0 = mx0 THEN mn0 - 0.5 ELSE mn0 END AS mn,
             CASE WHEN mn0 = mx0 THEN mx0 + 0.5 ELSE mx0 END AS mx, n FROM st),
c AS (SELECT CAST(least({bins - 1}, CAST(floor(({col} - b.mn) * {float(bins)} / (b.mx - b.mn)) AS INTEGER)) AS INTEGER) AS bin,
             CAST(count(*) AS BIGINT) AS count
  FROM cat, b WHERE {col} IS NOT NULL AND NOT isnan({col}) GROUP BY 1),
spine AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins}))
SELECT s.bin, {R6('b.mn + s.bin * ((b.mx - b.mn) / ' + str(float(bins)) + ')')} AS lo,
  {R6('b.mn + (s.bin + 1) * ((b.mx - b.mn) / ' + str(float(bins)) + ')')} AS hi,
  coalesce(c.count, 0) AS count,
  {R6('coalesce(c.count, 0) / (CAST(b.n AS DOUBLE) * ((b.mx - b.mn) / ' + str(float(bins)) + '))')} AS density
FROM spine s CROSS JOIN b LEFT JOIN c ON s.bin = c.bin"""


def _hist_q(col):
    def q(spark, sf):
        h = ex.histogram_equal_width(cat(spark, sf), col, 50)
        return h.select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "count",
                        r6("density").alias("density"))
    return q


register("histogram_equal_width", build(_hist_sql("magnitude").replace("st AS", "st AS", 1), "cat")
         .replace("\nst AS", ",\nst AS", 1))(_hist_q("magnitude"))
register("histogram_density", build(_hist_sql("depth"), "cat").replace("\nst AS", ",\nst AS", 1))(
    _hist_q("depth"))


@register("histogram_step", build(f"""SELECT CAST(floor(magnitude * 5.0 + 1e-9) AS BIGINT) AS bin,
  CAST(count(*) AS BIGINT) AS count, {R6('CAST(floor(magnitude * 5.0 + 1e-9) AS BIGINT) * 0.2')} AS lo
FROM clean WHERE magnitude IS NOT NULL GROUP BY 1""", "clean"))
def q_histogram_step(spark, sf):
    h = ex.histogram_step(clean(spark, sf), "magnitude", 0.2)
    return h.select("bin", "count", r6("lo").alias("lo"))


@register("kde_1d", build(f"""
, v AS (SELECT magnitude AS x FROM cat WHERE magnitude IS NOT NULL AND NOT isnan(magnitude)),
st AS (SELECT count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM v),
p AS (SELECT n, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw, mn, mx FROM st),
g AS (SELECT CAST(range AS INTEGER) AS g FROM range(200)),
w AS (SELECT x, count(*) AS w FROM v GROUP BY x),
grid AS (SELECT g.g, (p.mn - 3.0 * p.bw) + g.g * (((p.mx + 3.0 * p.bw) - (p.mn - 3.0 * p.bw)) / 199.0) AS gx,
                p.bw, p.n FROM g, p)
SELECT grid.g, {R6('grid.gx')} AS x,
  {R6('sum(w.w * exp(-0.5 * ((grid.gx - w.x) / grid.bw) * ((grid.gx - w.x) / grid.bw))) / (CAST(grid.n AS DOUBLE) * grid.bw * 2.5066282746310002)')} AS density
FROM grid, w GROUP BY grid.g, grid.gx, grid.bw, grid.n""".lstrip(), "cat").replace("\n, v AS", ",\nv AS")
          .replace(")\n, v AS", "),\nv AS"))
def q_kde_1d(spark, sf):
    k = ex.kde_1d(cat(spark, sf), "magnitude")
    return k.select("g", r6("x").alias("x"), r6("density").alias("density"))


@register("correlation", build(f"""SELECT {R6('corr(depth, magnitude)')} AS pearson_r,
  CAST(count(*) AS BIGINT) AS n FROM clean WHERE depth IS NOT NULL AND magnitude IS NOT NULL""", "clean"))
def q_correlation(spark, sf):
    c = ex.correlation(clean(spark, sf))
    return c.select(r6("pearson_r").alias("pearson_r"), "n")


@register("ols_trend", build(f"""SELECT {R6('regr_slope(magnitude, depth)')} AS slope,
  {R6('regr_intercept(magnitude, depth)')} AS intercept, {R6('regr_r2(magnitude, depth)')} AS r2,
  CAST(regr_count(magnitude, depth) AS BIGINT) AS n
FROM clean WHERE depth IS NOT NULL AND magnitude IS NOT NULL""", "clean"))
def q_ols(spark, sf):
    o = ex.ols_trend(clean(spark, sf))
    return o.select(r6("slope").alias("slope"), r6("intercept").alias("intercept"),
                    r6("r2").alias("r2"), o["n"].cast("long").alias("n"))


# ---------------------------------------------------------------------------
# 2.7 top-k and sampling
# ---------------------------------------------------------------------------
@register("sample_exact_n", build("""SELECT * FROM clean
ORDER BY md5(CAST(event_id AS VARCHAR) || '42'), event_id LIMIT 5000""", "clean"))
def q_sample(spark, sf):
    return tk.sample_exact_n(clean(spark, sf), 5000)


@register("top_magnitude_markers", build("""SELECT * FROM clean ORDER BY magnitude DESC NULLS LAST, event_id
LIMIT 5000""", "clean"))
def q_top_markers(spark, sf):
    return tk.top_magnitude_markers(clean(spark, sf), MARKER_CAP)


# ---------------------------------------------------------------------------
# 2.10 text
# ---------------------------------------------------------------------------
@register("event_labels", build("""SELECT event_id,
  coalesce(strftime(datetime, '%d %B %Y, %H:%M:%S WIB'), 'Tidak tersedia') AS dt_label,
  coalesce(strftime(datetime, '%Y-%m-%d'), 'N/A') AS date_label,
  coalesce(strftime(datetime, '%H:%M:%S'), 'N/A') AS time_label FROM cat""", "cat"))
def q_event_labels(spark, sf):
    return tx.event_labels(cat(spark, sf)).select("event_id", "dt_label", "date_label", "time_label")


@register("event_popup_text", build(f"""SELECT event_id,
  printf('Waktu: %s | Tanggal: %s | Jam: %s | Magnitudo: %s | Lokasi: %s | Koordinat: (%s, %s)',
    coalesce(strftime(datetime, '%d %B %Y, %H:%M:%S WIB'), 'Tidak tersedia'),
    coalesce(strftime(datetime, '%Y-%m-%d'), 'N/A'), coalesce(strftime(datetime, '%H:%M:%S'), 'N/A'),
    coalesce({fixed_sql('magnitude', 2)}, 'N/A'), coalesce(location, 'N/A'),
    coalesce({fixed_sql('latitude', 4)}, 'N/A'), coalesce({fixed_sql('longitude', 4)}, 'N/A')) AS popup
FROM cat""", "cat"))
def q_popup(spark, sf):
    return tx.event_popup_text(cat(spark, sf)).select("event_id", "popup")
