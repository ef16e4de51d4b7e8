"""Registered queries: file round trips (CSV, JSON documents, Parquet
statistics and weights), prediction reuse/fallback, stream scoring, and the
remaining label/density operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import anomaly as an
from ..operators import forecast as fc
from ..operators import net
from ..operators import ordering as od
from ..operators import scale as sc
from ..operators import spatial as sp
from ..schema import AE_LATENT_LAYER, AE_LAYERS, FEATURES, METHOD_FREQUENCY, TARGET_YEAR
from ..session import scratch_path
from ..sources import files as io
from ..sources import fixtures as fx
from ..streaming.score import running_threshold, stream_score_records, stream_score_running
from .q_core import HOTSPOT_FREQ_BODY, clean
from .q_learn import CHECK_PARAMS, ZF, dedup
from .q_series import series
from .registry import register
from .sqlkit import R6, build, r6

F4 = list(FEATURES)


_READ_SQL = f"""SELECT event_id + 7 AS note, {fx.PARSE_DT_SQL.format(c='datetime')} AS datetime,
  {fx.PARSE_NUM_SQL.format(c='magnitude')} AS magnitude, depth, latitude, longitude, location FROM cat_raw"""


@register("read_catalog", build(_READ_SQL, "cat_raw"))
def q_read_catalog(spark, sf):
    """A CSV with its columns in another order, one extra and no event_id."""
    path = scratch_path(spark, "catalog-csv")
    text = fx.catalog_text(spark, sf, junk=True).withColumn("note", F.col("event_id") + 7)
    io.write_csv(text.select("location", "depth", "datetime", "note", "longitude", "magnitude", "latitude"), path)
    return io.read_catalog(spark, path, "csv").select(
        F.col("note").cast("long").alias("note"), "datetime", "magnitude", "depth", "latitude", "longitude", "location")


@register("read_catalog_csv", build(_READ_SQL.replace("event_id + 7 AS note", "event_id"), "cat_raw"))
def q_read_catalog_csv(spark, sf):
    path = scratch_path(spark, "catalog-csv")
    io.write_csv(fx.catalog_text(spark, sf, junk=True), path)
    return io.read_catalog(spark, path, "csv").select(
        "event_id", "datetime", "magnitude", "depth", "latitude", "longitude", "location")


@register("read_catalog_folder", build(f"""SELECT note, place AS event_id, set, {fx.PARSE_DT_SQL.format(c='datetime')} AS datetime,
  {fx.PARSE_NUM_SQL.format(c='magnitude')} AS magnitude, depth, latitude, longitude, CASE WHEN set = 1 THEN location END AS location
FROM (SELECT *, event_id AS note, CAST(abs(event_id) % 3 AS INTEGER) AS set,
  row_number() OVER (ORDER BY abs(event_id) % 3, event_id) - 1 AS place FROM (SELECT * FROM cat_raw))""", "cat_raw"))
def q_read_catalog_folder(spark, sf):
    """Three exports in one folder: their columns differ in order and number,
    and no row has an id, so ids are the rows' places in the folder."""
    path = scratch_path(spark, "catalog-folder")
    text = fx.catalog_text(spark, sf, junk=True).withColumn("note", F.col("event_id"))
    heads = (("datetime", "latitude", "longitude", "magnitude", "depth", "note"),
             ("note", "depth", "magnitude", "location", "longitude", "latitude", "datetime"),
             ("magnitude", "datetime", "note", "depth", "latitude", "longitude"))
    for i, head in enumerate(heads):
        part = text.where(F.abs("event_id") % 3 == i)
        io.write_csv(od.sorted_by_range(part, [F.col("event_id").asc()], 3).select(*head), f"{path}/set={i}")
    return io.read_catalog(spark, path, "csv").select(
        F.col("note").cast("long").alias("note"), "event_id", "set", "datetime", "magnitude", "depth", "latitude", "longitude", "location")


@register("write_csv", build("SELECT pos, year, magnitude, depth, latitude, longitude FROM feat", "feat"))
def q_write_csv(spark, sf):
    path = scratch_path(spark, "features-csv")
    io.write_csv(dedup(spark, sf).select("pos", "year", *F4), path)
    return spark.read.schema("pos long, year int, magnitude double, depth double, latitude double, "
                             "longitude double").option("header", True).csv(path)


@register("read_preprocessed", build("SELECT magnitude, depth, latitude, longitude FROM feat", "feat"))
def q_read_preprocessed(spark, sf):
    path = scratch_path(spark, "preprocessed-csv")
    io.write_csv(dedup(spark, sf).select("longitude", "pos", "depth", "magnitude", "latitude"), path)
    return io.read_preprocessed(spark, path)


_POINTS_SQL = f"""SELECT row_number() OVER (ORDER BY count DESC, lat, lon) - 1 AS rank, lat, lon, count,
  historical_count, mag, year, month FROM ({HOTSPOT_FREQ_BODY})"""


def _saved_points(spark, sf):
    path = scratch_path(spark, "predictions-json")
    pts = sp.hotspots_frequency(clean(spark, sf))
    io.write_predictions(pts, METHOD_FREQUENCY, path, k=15)
    return path


@register("write_predictions", build(f"""SELECT '{METHOD_FREQUENCY}' AS method, CAST(count(*) AS INTEGER) AS n_points,
  CAST(sum(count) AS BIGINT) AS total_count FROM ({HOTSPOT_FREQ_BODY})""", "cells"))
def q_write_predictions(spark, sf):
    doc = io.read_prediction_doc(spark, _saved_points(spark, sf))
    return doc.select("method", F.size("hotspot_points").alias("n_points"),
                      F.aggregate("hotspot_points", F.lit(0).cast("long"), lambda a, p: a + p["count"])
                      .alias("total_count"))


@register("read_predictions", build(
    f"SELECT rank, lat, lon, count, historical_count, mag, year, month FROM ({_POINTS_SQL})", "cells"))
def q_read_predictions(spark, sf):
    pts = io.read_predictions(spark, _saved_points(spark, sf))
    return pts.select("rank", "lat", "lon", "count", "historical_count", r6("mag").alias("mag"), "year", "month")


@register("saved_topk_slice", build(f"""SELECT rank, lat, lon, count FROM ({_POINTS_SQL}) WHERE rank < 5""",
                                    "cells"))
def q_saved_topk_slice(spark, sf):
    pts = io.read_predictions(spark, _saved_points(spark, sf))
    return io.saved_topk_slice(pts, 5).select("rank", "lat", "lon", "count")


@register("save_scaler", build(f"""SELECT 'magnitude' AS feature, {R6('mu0')} AS mean, {R6('sd0')} AS std FROM fstats
UNION ALL SELECT 'depth', {R6('mu1')}, {R6('sd1')} FROM fstats
UNION ALL SELECT 'latitude', {R6('mu2')}, {R6('sd2')} FROM fstats
UNION ALL SELECT 'longitude', {R6('mu3')}, {R6('sd3')} FROM fstats""", "feat"))
def q_save_scaler(spark, sf):
    path = scratch_path(spark, "scaler")
    d = dedup(spark, sf)
    loaded = io.load_scaler(spark, path, fit=lambda: sc.standard_stats(d))
    return loaded.select("feature", r6("mean").alias("mean"), r6("std").alias("std"))


_SCALER_SQL = build(f"""SELECT 'magnitude' AS feature, {R6('mu0')} AS mean, {R6('sd0')} AS std FROM fstats
UNION ALL SELECT 'depth', {R6('mu1')}, {R6('sd1')} FROM fstats
UNION ALL SELECT 'latitude', {R6('mu2')}, {R6('sd2')} FROM fstats
UNION ALL SELECT 'longitude', {R6('mu3')}, {R6('sd3')} FROM fstats""", "feat")


@register("load_scaler", _SCALER_SQL)
def q_load_scaler(spark, sf):
    """Missing file -> fit and save; second load reads the saved rows."""
    path = scratch_path(spark, "scaler")
    d = dedup(spark, sf)
    io.load_scaler(spark, path, fit=lambda: sc.standard_stats(d))
    loaded = io.load_scaler(spark, path)
    return loaded.select("feature", r6("mean").alias("mean"), r6("std").alias("std"))


def _saved_model(spark, sf):
    """The network over raw features: the scaler fitted on the table is part of
    its first layer."""
    path = scratch_path(spark, "model")
    st = sc.fit_standard(dedup(spark, sf))
    io.save_model(net.weights_table(spark, net.fold_scaler(CHECK_PARAMS, st.mean, st.std)), path)
    return path


def _first_layer_sql():
    """Absolute sum of the first layer's weights and biases from the scaler's
    statistics."""
    w, b = CHECK_PARAMS[0]
    weights = [f"abs({float(w[i, j])!r} / sd{i})" for i in range(w.shape[0]) for j in range(w.shape[1])]
    biases = [f"abs({float(b[j])!r} - ({' + '.join(f'mu{i} * ({float(w[i, j])!r} / sd{i})' for i in range(w.shape[0]))}))" for j in range(w.shape[1])]
    return " + ".join(weights + biases)


@register("save_model", build(f"""SELECT CAST(0 AS INTEGER) AS layer, CAST({CHECK_PARAMS[0][0].size + CHECK_PARAMS[0][1].size} AS BIGINT) AS n_values,
  {R6(_first_layer_sql())} AS l1 FROM fstats UNION ALL SELECT layer, n_values, {R6('l1')} FROM (VALUES """ + ", ".join(
    f"(CAST({i} AS INTEGER), CAST({w.size + b.size} AS BIGINT), {float(abs(w).sum() + abs(b).sum())!r})"
    for i, (w, b) in enumerate(CHECK_PARAMS) if i) + ") t(layer, n_values, l1)", "feat"))
def q_save_model(spark, sf):
    w = io.load_model(spark, _saved_model(spark, sf))
    return w.groupBy("layer").agg(F.count(F.lit(1)).alias("n_values"), r6(F.sum(F.abs("value"))).alias("l1"))


@register("load_model", build(f"SELECT pos, {', '.join(R6(f'en_{j}') + f' AS latent_feature_{j}' for j in range(5))} FROM en", "encnet"))
def q_load_model(spark, sf):
    """Latents of raw features by the loaded weights."""
    params = net.params_from_rows(io.load_model(spark, _saved_model(spark, sf)).collect(), AE_LAYERS)
    out = net.score_arrow(dedup(spark, sf), params, F4, mode="latent", upto=AE_LATENT_LAYER)
    return out.select("pos", *[r6(f"latent_feature_{j}").alias(f"latent_feature_{j}") for j in range(5)])


@register("reuse_predictions", build(
    f"SELECT rank, lat, lon, count, historical_count, mag, year, month FROM ({_POINTS_SQL}) WHERE rank < 10",
    "cells"))
def q_reuse_predictions(spark, sf):
    path = scratch_path(spark, "reuse-json")
    compute = lambda: sp.hotspots_frequency(clean(spark, sf), top_k=15)
    first, reused1 = io.reuse_predictions(spark, path, METHOD_FREQUENCY, 15, compute)
    second, reused2 = io.reuse_predictions(spark, path, METHOD_FREQUENCY, 10, compute)
    assert not reused1 and reused2
    return second.select("rank", "lat", "lon", "count", "historical_count", r6("mag").alias("mag"),
                         "year", "month")


@register("forecast_with_fallback", build(
    f"SELECT *, '{METHOD_FREQUENCY}' AS method FROM ({HOTSPOT_FREQ_BODY})", "cells"))
def q_forecast_with_fallback(spark, sf):
    """No model available -> the frequency ranking (and its method name)."""
    from ..operators.forecast import hotspots_forecast_or_frequency
    pts, method = hotspots_forecast_or_frequency(clean(spark, sf), None)
    return pts.withColumn("mag", r6("mag")).withColumn("method", F.lit(method))


_FORECAST_BODY = f"""SELECT lat_bin AS lat, lon_bin AS lon, CAST(greatest(0.0, round_even({fc.WEIGHTED_AVERAGE.sql()} * s_range + s_min, 0)) AS BIGINT) AS count,
  CAST(historical_count AS BIGINT) AS historical_count, {R6('mean_mag')} AS mag, CAST({TARGET_YEAR} AS INTEGER) AS year, CAST(NULL AS INTEGER) AS month
  FROM lastseq ORDER BY count DESC, lat, lon LIMIT 15"""


@register("forecast_with_fallback_model", build(f"SELECT *, '{fc.WEIGHTED_AVERAGE.method}' AS method FROM ({_FORECAST_BODY})", "lastseq"))
def q_forecast_with_fallback_model(spark, sf):
    """A model and usable series -> the model's forecast and its name."""
    from ..operators.forecast import hotspots_forecast_or_frequency
    pts, method = hotspots_forecast_or_frequency(clean(spark, sf), fc.WEIGHTED_AVERAGE)
    return pts.withColumn("mag", r6("mag")).withColumn("method", F.lit(method))


@register("forecast_with_fallback_unusable", build(
    f"SELECT *, '{METHOD_FREQUENCY}' AS method FROM ({HOTSPOT_FREQ_BODY})", "cells").replace(
    "FROM clean WHERE latitude", "FROM clean WHERE year = 2015 AND latitude"))
def q_forecast_with_fallback_unusable(spark, sf):
    """A model but no cell with enough years -> an empty forecast, so the
    frequency ranking."""
    from ..operators.forecast import hotspots_forecast_or_frequency
    pts, method = hotspots_forecast_or_frequency(clean(spark, sf).where("year = 2015"), fc.WEIGHTED_AVERAGE)
    return pts.withColumn("mag", r6("mag")).withColumn("method", F.lit(method))


@register("stream_score_records", build(f"""SELECT r.event_id, {R6('r.err')} AS reconstruction_error,
  CAST(r.err > t.threshold AS INTEGER) AS is_anomaly FROM rec_scored r, thr t""", "records"))
def q_stream_score_records(spark, sf):
    from .q_core import cat
    d = dedup(spark, sf)
    stats = sc.fit_standard(d)
    thr = an.anomaly_threshold(net.score_arrow(sc.standard_scale(d, stats, "z_"), CHECK_PARAMS, ZF)).first()["threshold"]
    src, sink, ckpt = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-ckpt"))
    cat(spark, sf).repartition(8, "event_id").write.parquet(src)
    stream_score_records(spark, src, sink, ckpt, stats, CHECK_PARAMS, thr)
    out = spark.read.parquet(sink)
    return out.select("event_id", r6("reconstruction_error").alias("reconstruction_error"), "is_anomaly")


@register("stream_score_running", build(f"""SELECT count(*) AS n, count(*) AS n_ids, {R6('avg(r.err) + 3.0 * stddev_pop(r.err)')} AS threshold,
  {R6('avg(r.err)')} AS mean_error FROM rec_scored r JOIN cat c ON r.event_id = c.event_id WHERE c.datetime IS NOT NULL""", "records"))
def q_stream_score_running(spark, sf):
    """Two runs of a stream; the second one's files replay half of the first's."""
    from .q_core import cat
    stats = sc.fit_standard(dedup(spark, sf))
    src, sink, ckpt, state = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-ckpt", "stream-state"))
    records = cat(spark, sf)
    args = (spark, src, sink, ckpt, state, stats, CHECK_PARAMS, "10000 days")
    records.where("event_id % 3 <> 0").repartition(6, "event_id").write.parquet(src)
    stream_score_running(*args)
    records.where("event_id % 3 = 0 or event_id % 2 = 0").repartition(6, "event_id").write.mode("append").parquet(src)
    stream_score_running(*args)
    got = spark.read.parquet(sink).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"))
    last = running_threshold(spark, state)
    return got.select("n", "n_ids", r6(last.select("threshold").scalar()).alias("threshold"), r6(last.select("mean_error").scalar()).alias("mean_error"))


_FIX = "printf('%.{1}f', floor({0} * {2} + 0.5) / {2})"
_LAT, _LON, _MAG = (_FIX.format(c, dp, float(10 ** dp)) for c, dp in (("lat", 4), ("lon", 4), ("mag", 2)))


@register("hotspot_label", build(f"""SELECT lat, lon,
  printf('Tahun Prediksi: %d | ', year) || coalesce('Bulan: ' || lpad(CAST(month AS VARCHAR), 2, '0') || ' | ', '')
  || printf('Latitude: %s° | Longitude: %s° | Magnitudo Estimasi: %s | ', {_LAT}, {_LON}, {_MAG}) ||
  CASE WHEN historical_count IS NOT NULL AND historical_count <> count
       THEN printf('Frekuensi Historis (%d-%d): %d kejadian | Prediksi Frekuensi %d: %d kejadian',
                   2008, 2025, historical_count, year, count)
       ELSE printf('Frekuensi Historis: %d kejadian', count) END AS label,
  printf('Hotspot: %s°, %s° | Mag: %s', {_LAT}, {_LON}, {_MAG}) AS tooltip
FROM (SELECT lat_bin AS lat, lon_bin AS lon, CAST(greatest(0.0, round_even({fc.WEIGHTED_AVERAGE.sql()} * s_range + s_min, 0)) AS BIGINT) AS count,
  historical_count, mean_mag AS mag, CAST(2026 AS INTEGER) AS year, CAST(NULL AS INTEGER) AS month
  FROM lastseq ORDER BY count DESC, lat, lon LIMIT 15)""", "lastseq"))
def q_hotspot_label(spark, sf):
    pts = fc.hotspots_forecast(series(spark, sf), fc.WEIGHTED_AVERAGE)
    return tx.hotspot_label(pts).select("lat", "lon", "label", "tooltip")
