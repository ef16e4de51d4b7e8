"""Registered queries: cell series, windows, splits, yearly chart forecasts
and next-year hotspot forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cells import cell_sql
from ..operators import forecast as fc
from ..operators import series as se
from ..operators import topk as tk
from .q_core import clean
from .registry import register
from .sqlkit import R6, build, cte, r6

YEARS = list(range(2008, 2026))
_counts = ", ".join(f"CAST(count_if(year = {y}) AS BIGINT)" for y in YEARS)

cte("ser", f"""ser_raw AS (
  SELECT lat_bin, lon_bin, avg(magnitude) AS mean_mag,
    CAST(count(DISTINCT year) AS INTEGER) AS n_years, [{_counts}] AS series
  FROM (SELECT {cell_sql('latitude')} AS lat_bin, {cell_sql('longitude')} AS lon_bin, magnitude, year
        FROM clean WHERE latitude IS NOT NULL AND longitude IS NOT NULL)
  GROUP BY 1, 2),
ser AS (
  SELECT *, CAST(list_sum(series) AS BIGINT) AS historical_count FROM ser_raw
  WHERE n_years >= 3 AND list_sum(series) > 0)""", ("clean",))
cte("scaled", """scaled0 AS (
  SELECT *, CAST(list_min(series) AS DOUBLE) AS s_min,
    CASE WHEN CAST(list_max(series) AS DOUBLE) - CAST(list_min(series) AS DOUBLE) = 0 THEN 1.0
         ELSE CAST(list_max(series) AS DOUBLE) - CAST(list_min(series) AS DOUBLE) END AS s_range
  FROM ser),
scaled AS (
  SELECT *, list_transform(series, lambda x: (CAST(x AS DOUBLE) - s_min) / s_range) AS sc FROM scaled0)""",
    ("ser",))
cte("lastseq", """lastseq AS (
  SELECT *, sc[14] AS x0, sc[15] AS x1, sc[16] AS x2, sc[17] AS x3, sc[18] AS x4 FROM scaled)""",
    ("scaled",))
cte("seqs", """seqs AS (
  SELECT lat_bin, lon_bin, i, s_min, s_range, sc[i + 1] AS x0, sc[i + 2] AS x1, sc[i + 3] AS x2,
    sc[i + 4] AS x3, sc[i + 5] AS x4, sc[i + 6] AS y
  FROM (SELECT *, unnest(range(0, len(sc) - 5)) AS i FROM scaled WHERE len(sc) > 5))""", ("scaled",))
cte("split", """split AS (
  SELECT *, row_number() OVER (ORDER BY md5(CAST(CAST(round_even(lat_bin / 0.5, 0) AS BIGINT) AS VARCHAR) || ':' ||
      CAST(CAST(round_even(lon_bin / 0.5, 0) AS BIGINT) AS VARCHAR) || ':' || CAST(i AS VARCHAR) || ':42')) - 1 AS r,
    count(*) OVER () AS n
  FROM seqs),
split2 AS (
  SELECT *, CASE WHEN n <= 10 THEN 1 ELSE CAST(r < ceil(CAST(n AS DOUBLE) * 0.19999999999999996) AS INTEGER) END AS is_test,
    CASE WHEN n <= 10 THEN 1 ELSE CAST(r >= ceil(CAST(n AS DOUBLE) * 0.19999999999999996) AS INTEGER) END AS is_train
  FROM split)""", ("seqs",))
cte("chart", """yr AS (
  SELECT year, CAST(count(*) AS BIGINT) AS frequency FROM clean WHERE year BETWEEN 2008 AND 2025 GROUP BY year),
obs AS (SELECT year, frequency, row_number() OVER (ORDER BY year DESC) AS rk, count(*) OVER () AS k FROM yr),
fc AS (
  SELECT CASE WHEN (SELECT count(*) FROM yr) = 0 THEN CAST(0 AS BIGINT)
    WHEN (SELECT count(*) FROM yr) < 5 THEN CAST(round_even((SELECT sum(frequency) FROM yr) / CAST((SELECT count(*) FROM yr) AS DOUBLE), 0) AS BIGINT)
    WHEN (SELECT min(frequency) = max(frequency) FROM obs WHERE rk <= 5)
      THEN CAST(round_even((SELECT sum(CAST(frequency AS DOUBLE)) FROM obs WHERE rk <= 5) / 5.0, 0) AS BIGINT)
    ELSE CAST(round_even((SELECT ((((CAST(sum(frequency) FILTER (WHERE rk = 5) AS DOUBLE) * 0.0
        + CAST(sum(frequency) FILTER (WHERE rk = 4) AS DOUBLE) * 1.0)
        + CAST(sum(frequency) FILTER (WHERE rk = 3) AS DOUBLE) * 2.0)
        + CAST(sum(frequency) FILTER (WHERE rk = 2) AS DOUBLE) * 3.0)
        + CAST(sum(frequency) FILTER (WHERE rk = 1) AS DOUBLE) * 4.0) FROM obs) / 10.0, 0) AS BIGINT) END AS forecast),
fcm AS (
  SELECT CASE WHEN (SELECT count(*) FROM yr) = 0 THEN CAST(0 AS BIGINT)
    ELSE CAST(round_even((SELECT sum(CAST(frequency AS DOUBLE)) FROM obs WHERE rk <= 5)
      / CAST(least(5, (SELECT count(*) FROM yr)) AS DOUBLE), 0) AS BIGINT) END AS forecast),
spine AS (
  SELECT CAST(s.range AS INTEGER) AS year, coalesce(yr.frequency, CAST(0 AS BIGINT)) AS frequency,
    'Historical' AS type
  FROM range(2008, 2027) s LEFT JOIN yr ON CAST(s.range AS INTEGER) = yr.year),
chart AS (
  SELECT year, CASE WHEN year = 2026 THEN (SELECT forecast FROM fc) ELSE frequency END AS frequency,
    CASE WHEN year = 2026 THEN 'Predicted' ELSE type END AS type FROM spine)""", ("clean",))


def series(spark, sf):
    return se.cell_year_series(clean(spark, sf))


def scaled(spark, sf):
    return se.minmax_scale_series(series(spark, sf))


def sequences(spark, sf):
    return se.sliding_sequences(scaled(spark, sf))


def split(spark, sf):
    s = sequences(spark, sf)
    key = se.split_key([F.rint(F.col("lat_bin") / 0.5), F.rint(F.col("lon_bin") / 0.5), F.col("i")])
    return se.train_test_split(s, key)


def chart(spark, sf, method="trend"):
    return se.forecast_chart_table(clean(spark, sf), method)


@register("cell_year_series", build(f"""SELECT lat_bin, lon_bin, {R6('mean_mag')} AS mean_mag, n_years,
  array_to_string(series, ',') AS series, historical_count FROM ser""", "ser"), headline=True)
def q_cell_year_series(spark, sf):
    s = series(spark, sf)
    return s.select("lat_bin", "lon_bin", r6("mean_mag").alias("mean_mag"), "n_years",
                    F.array_join(F.col("series").cast("array<string>"), ",").alias("series"),
                    "historical_count")


@register("minmax_scale_series", build("""SELECT lat_bin, lon_bin, i, sc[i + 1] AS value, s_min, s_range
FROM (SELECT *, unnest(range(0, len(sc))) AS i FROM scaled)""", "scaled"))
def q_minmax_scale_series(spark, sf):
    s = scaled(spark, sf)
    return s.select("lat_bin", "lon_bin", "s_min", "s_range", F.posexplode("scaled").alias("i", "value")) \
        .select("lat_bin", "lon_bin", F.col("i").cast("bigint").alias("i"), "value", "s_min", "s_range")


@register("minmax_inverse_series", build("""SELECT lat_bin, lon_bin, i, sc[i + 1] * s_range + s_min AS value
FROM (SELECT *, unnest(range(0, len(sc))) AS i FROM scaled)""", "scaled"))
def q_minmax_inverse_series(spark, sf):
    s = scaled(spark, sf)
    e = s.select("lat_bin", "lon_bin", "s_min", "s_range", F.posexplode("scaled").alias("i", "v"))
    return e.select("lat_bin", "lon_bin", F.col("i").cast("bigint").alias("i"),
                    se.minmax_inverse("v").alias("value"))


@register("last_sequence", build("SELECT lat_bin, lon_bin, x0, x1, x2, x3, x4 FROM lastseq", "lastseq"))
def q_last_sequence(spark, sf):
    return se.last_sequence(scaled(spark, sf)).select("lat_bin", "lon_bin", *fc.XS)


@register("sliding_sequences", build(
    "SELECT lat_bin, lon_bin, i, x0, x1, x2, x3, x4, y FROM seqs", "seqs"))
def q_sliding_sequences(spark, sf):
    return sequences(spark, sf).select("lat_bin", "lon_bin", F.col("i").cast("bigint").alias("i"),
                                       *fc.XS, "y")


@register("train_test_split", build(
    "SELECT lat_bin, lon_bin, i, is_test, is_train FROM split2", "split"))
def q_train_test_split(spark, sf):
    return split(spark, sf).select("lat_bin", "lon_bin", F.col("i").cast("bigint").alias("i"),
                                   "is_test", "is_train")


@register("training_workload", build("""SELECT CAST(count(*) AS BIGINT) AS cells,
  CAST(coalesce(sum(greatest(0, len(series) - 5)), 0) AS BIGINT) AS sequences,
  CAST(greatest(1, floor(coalesce(sum(greatest(0, len(series) - 5)), 0) / 32)) AS BIGINT) AS batches_per_epoch,
  CAST(greatest(1, floor(coalesce(sum(greatest(0, len(series) - 5)), 0) / 32)) * 30 AS BIGINT) AS total_batches
FROM ser""", "ser"))
def q_training_workload(spark, sf):
    return se.training_workload(series(spark, sf))


@register("yearly_trend_forecast", build("SELECT forecast FROM fc", "chart"))
def q_yearly_trend_forecast(spark, sf):
    c = clean(spark, sf)
    yearly = c.where(F.col("year").between(2008, 2025)).groupBy("year").agg(F.count(F.lit(1)).alias("frequency"))
    return se.yearly_trend_forecast(yearly)


@register("yearly_mean_forecast", build("SELECT forecast FROM fcm", "chart"))
def q_yearly_mean_forecast(spark, sf):
    c = clean(spark, sf)
    yearly = c.where(F.col("year").between(2008, 2025)).groupBy("year").agg(F.count(F.lit(1)).alias("frequency"))
    return se.yearly_mean_forecast(yearly)


@register("last_n_years", build("SELECT year, frequency FROM yr ORDER BY year DESC LIMIT 5", "chart"))
def q_last_n_years(spark, sf):
    c = clean(spark, sf)
    yearly = c.where(F.col("year").between(2008, 2025)).groupBy("year").agg(F.count(F.lit(1)).alias("frequency"))
    return tk.last_n_years(yearly, 5)


@register("year_spine_join", build("SELECT year, frequency, type FROM spine", "chart"))
def q_year_spine_join(spark, sf):
    c = clean(spark, sf)
    yearly = c.where(F.col("year").between(2008, 2025)).groupBy("year").agg(F.count(F.lit(1)).alias("frequency"))
    return se.year_spine_join(c, yearly)


@register("forecast_chart_table", build("SELECT year, frequency, type FROM chart", "chart"), headline=True)
def q_forecast_chart_table(spark, sf):
    return chart(spark, sf, "trend")


@register("upsert_forecast_year", build("""SELECT year,
  CASE WHEN year = 2026 THEN (SELECT forecast FROM fcm) ELSE frequency END AS frequency,
  CASE WHEN year = 2026 THEN 'Predicted' ELSE type END AS type FROM spine""", "chart"))
def q_upsert_forecast_year(spark, sf):
    return chart(spark, sf, "mean")


@register("history_summary", build(f"""SELECT CAST(sum(frequency) AS BIGINT) AS total,
  {R6('avg(frequency)')} AS mean, max(frequency) AS max_frequency,
  min(year) FILTER (WHERE frequency = (SELECT max(frequency) FROM chart WHERE type = 'Historical')) AS max_year
FROM chart WHERE type = 'Historical'""", "chart"))
def q_history_summary(spark, sf):
    h = se.history_summary(chart(spark, sf))
    return h.select("total", r6("mean").alias("mean"), "max_frequency", "max_year")


@register("forecast_delta", build(f"""SELECT f.forecast, l.last_value, f.forecast - l.last_value AS change,
  {R6("CASE WHEN l.last_value > 0 THEN CAST(f.forecast - l.last_value AS DOUBLE) / l.last_value * 100.0 ELSE 0.0 END")} AS change_pct
FROM (SELECT max(frequency) AS forecast FROM chart WHERE type = 'Predicted' AND year = 2026) f,
     (SELECT coalesce(max(frequency) FILTER (WHERE type = 'Historical' AND year = 2025), 0) AS last_value FROM chart) l""",
    "chart"))
def q_forecast_delta(spark, sf):
    d = se.forecast_delta(chart(spark, sf))
    return d.select("forecast", "last_value", "change", r6("change_pct").alias("change_pct"))


# ---------------------------------------------------------------------------
# Next-year hotspots (fixed weighted-average forecaster: SQL-checkable)
# ---------------------------------------------------------------------------
_W = fc.WEIGHTED_AVERAGE


_NULL_CELL = "CAST(round_even(lat_bin * 2, 0) + round_even(lon_bin * 2, 0) AS BIGINT) % 7 = 0"


@register("hotspots_forecast", build(f"""SELECT lat_bin AS lat, lon_bin AS lon,
  CAST(greatest(0.0, round_even(CASE WHEN {_NULL_CELL} THEN x4 ELSE {_W.sql()} END * s_range + s_min, 0)) AS BIGINT) AS count,
  historical_count, {R6('mean_mag')} AS mag, CAST(2026 AS INTEGER) AS year, CAST(NULL AS INTEGER) AS month
FROM lastseq ORDER BY count DESC, lat, lon LIMIT 15""", "lastseq"), headline=True)
def q_hotspots_forecast(spark, sf):
    """Some cells get no prediction: they keep their last observed count."""
    class Gaps:
        def predict(self, df, out="pred_scaled"):
            gap = (F.rint(F.col("lat_bin") * 2) + F.rint(F.col("lon_bin") * 2)).cast("long") % 7 == 0
            return _W.predict(df, out).withColumn(out, F.when(~gap, F.col(out)))
    return fc.hotspots_forecast(series(spark, sf), Gaps()).withColumn("mag", r6("mag"))


@register("forecaster_metrics", build(f"""SELECT {R6(f'avg((y - {_W.sql()}) * (y - {_W.sql()}))')} AS mse,
  {R6(f'avg(abs(y - {_W.sql()}))')} AS mae, CAST(count(*) AS BIGINT) AS n
FROM split2 WHERE is_test = 1""", "split"))
def q_forecaster_metrics(spark, sf):
    m = fc.forecaster_metrics(_W, split(spark, sf).where(F.col("is_test") == 1))
    return m.select(r6("mse").alias("mse"), r6("mae").alias("mae"), "n")


# ---------------------------------------------------------------------------
# MLlib forecasters: weights have no SQL twin, but what they must satisfy has
# ---------------------------------------------------------------------------
_TRAIN_SQL = "SELECT CAST(count(*) AS BIGINT) AS n%s FROM split2 WHERE is_train = 1"


@register("fit_sequence_forecaster", build(_TRAIN_SQL % "".join(f", 0.0 AS r{i}" for i in range(6)), "split"))
def q_fit_sequence_forecaster(spark, sf):
    """Normal equations: the mean of residual times each lag (and of the
    residual itself, ``r5``) is 0 for least squares with an intercept."""
    train = split(spark, sf).where(F.col("is_train") == 1)
    lin = fc.linear_from_mllib(fc.fit_sequence_forecaster(train, "linear"))
    res = lin.predict(train).withColumn("r", F.col("y") - F.col("pred_scaled"))
    return res.agg(F.count(F.lit(1)).alias("n"),
                   *[r6(F.abs(F.avg(F.col("r") * F.col(f"x{i}")))).alias(f"r{i}") for i in range(5)],
                   r6(F.abs(F.avg("r"))).alias("r5"))


@register("fit_rf_forecaster", build("""SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS below, CAST(0 AS BIGINT) AS above
FROM split2 WHERE is_test = 1""", "split"))
def q_fit_rf_forecaster(spark, sf):
    """A forest averages training targets: no prediction leaves their range."""
    sp = split(spark, sf)
    train, test = sp.where(F.col("is_train") == 1), sp.where(F.col("is_test") == 1)
    pred = fc.fit_sequence_forecaster(train, "rf", numTrees=100, maxDepth=10).predict(test)
    lo, hi = train.agg(F.min("y")).scalar(), train.agg(F.max("y")).scalar()
    return pred.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred_scaled") < lo - 1e-9).alias("below"),
                    F.count_if(F.col("pred_scaled") > hi + 1e-9).alias("above"))


@register("hotspots_forecast_learned", build("""SELECT least(15, count(*)) AS n, least(15, count(*)) AS cells,
  CAST(0 AS BIGINT) AS negative, CAST(0 AS BIGINT) AS wrong_history FROM lastseq""", "lastseq"))
def q_hotspots_forecast_learned(spark, sf):
    """Least-squares forecast: as many distinct cells as asked for, no
    negative count, every cell with its own history."""
    sp, ser = split(spark, sf), series(spark, sf)
    model = fc.fit_sequence_forecaster(sp.where(F.col("is_train") == 1), "linear")
    pts = fc.hotspots_forecast(ser, model)
    own = se.last_sequence(se.minmax_scale_series(ser)).select(
        F.col("lat_bin").alias("lat"), F.col("lon_bin").alias("lon"), F.col("historical_count").alias("own"))
    j = pts.join(own, ["lat", "lon"], "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lat", "lon").alias("cells"),
                 F.count_if(F.col("count") < 0).alias("negative"),
                 F.count_if(F.coalesce(F.col("own") != F.col("historical_count"), F.lit(True))).alias("wrong_history"))
