"""Hand-made frames for the semantic traps."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sismo.functions.cells import cell_of
from sismo.functions.parse import parse_datetime_coerce, parse_datetime_strict, to_numeric_coerce
from sismo.operators import explore as ex
from sismo.operators import filters as flt
from sismo.operators import ordering as od
from sismo.operators import quantiles as qt
from sismo.operators import scale as sc
from sismo.operators import series as se
from sismo.operators import spatial as sp


def test_interpolate_position_linear_leading_trailing(spark):
    # T1: [null, 1, null, 3, null] -> [null, 1, 2, 3, 3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])],
                               "event_id long, v double")
    out = od.interpolate_linear(df, ["v"], order=[F.col("event_id")]).orderBy("pos").toPandas()
    assert out["pos"].tolist() == [0, 1, 2, 3, 4]
    assert math.isnan(out["v"][0]) or out["v"][0] is None
    assert out["v"][1:].tolist() == [1.0, 2.0, 3.0, 3.0]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_interpolate_matches_pandas_across_partitions(spark, parts):
    rng = np.random.default_rng(parts)
    n = 400
    vals = rng.normal(size=n)
    vals[rng.random(n) < 0.4] = np.nan
    vals[:5] = np.nan
    vals[-7:] = np.nan
    pdf = pd.DataFrame({"event_id": np.arange(n), "v": vals})
    df = spark.createDataFrame(pdf.astype({"v": "float64"})).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = od.interpolate_linear(df, ["v"], order=[F.col("event_id")], partitions=parts).orderBy("pos").toPandas()
    want = pdf["v"].interpolate()
    np.testing.assert_allclose(got["v"].to_numpy(dtype=float), want.to_numpy(), rtol=0, atol=1e-12,
                               equal_nan=True)


def test_global_position_with_hot_key(spark):
    # one timestamp holds most rows: the tie-break splits it across partitions
    rows = [(i, "2020-01-01 00:00:00" if i % 3 else f"2020-01-0{1 + i % 9} 00:00:00") for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, t string").withColumn("datetime", F.to_timestamp_ntz("t"))
    out = od.sort_by_time(df, partitions=6).toPandas()
    assert sorted(out["pos"]) == list(range(3000))
    want = out.sort_values(["datetime", "event_id"])["pos"].tolist()
    assert want == list(range(3000))


def test_cells_half_even_and_negative_zero(spark):
    # T5/T6: (0.25, 0.75) -> (0.0, 1.0); -0.25 -> 0.0 (not -0.0); (-6.2, 106.8) -> (-6.0, 107.0)
    df = spark.createDataFrame([(0.25, 0.75), (-0.25, -0.75), (-6.2, 106.8)], "la double, lo double")
    r = df.select(cell_of("la").alias("a"), cell_of("lo").alias("b")).collect()
    assert (r[0]["a"], r[0]["b"]) == (0.0, 1.0)
    assert math.copysign(1.0, r[1]["a"]) == 1.0 and r[1]["b"] == -1.0
    assert (r[2]["a"], r[2]["b"]) == (-6.0, 107.0)


def test_standard_scale_population_std_and_constant(spark):
    # T3: [1,2,3] -> +-1.2247 (population std); constant column -> std 1 -> 0
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    st = sc.fit_standard(df, ["a", "b"])
    out = sc.standard_scale(df, st).orderBy("a").toPandas()
    np.testing.assert_allclose(out["a"], [-1.224744871391589, 0.0, 1.224744871391589])
    assert out["b"].tolist() == [0.0, 0.0, 0.0]
    mm = sc.minmax_scale(df, sc.fit_minmax(df, ["a", "b"])).orderBy("a").toPandas()
    assert mm["a"].tolist() == [0.0, 0.5, 1.0] and mm["b"].tolist() == [0.0, 0.0, 0.0]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    vals = np.round(rng.normal(size=777), 1)       # many ties
    groups = rng.integers(0, 5, size=777)
    df = spark.createDataFrame(pd.DataFrame({"g": groups.astype(int), "v": vals}))
    got = qt.exact_quantiles(df, "v", (0.25, 0.5, 0.75), by=("g",), partitions=5).toPandas()
    for _, r in got.iterrows():
        x = vals[groups == r["g"]]
        np.testing.assert_allclose([r["q_0_25"], r["q_0_5"], r["q_0_75"]],
                                   np.percentile(x, [25, 50, 75]), atol=1e-12)


def test_histogram_last_bin_closed_and_spine(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 10]], "v double")
    h = ex.histogram_equal_width(df, "v", bins=5).orderBy("bin").toPandas()
    assert h["count"].tolist() == [2, 2, 0, 0, 1]        # 10 lands in the last bin
    assert len(h) == 5


def test_kde_integrates_to_one(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(x),) for x in rng.normal(size=500)], "v double")
    k = ex.kde_1d(df, "v").orderBy("g").toPandas()
    area = np.trapezoid(k["density"], k["x"])
    assert abs(area - 1.0) < 0.01


def test_trend_forecast_exact_half_even(spark):
    # T8: last five observed years; mean + slope = sum(i * y_i) / 10
    rows = [(2008 + i, f) for i, f in enumerate([5, 9, 3, 4, 6, 8, 10])]
    yearly = spark.createDataFrame(rows, "year int, frequency long")
    got = se.yearly_trend_forecast(yearly).first()["forecast"]
    y = np.array([3, 4, 6, 8, 10], dtype=float)
    want = np.polyfit(np.arange(5), y, 1)[0] + y.mean()
    assert got == round(want)
    few = spark.createDataFrame([(2010, 3), (2011, 4)], "year int, frequency long")
    assert se.yearly_trend_forecast(few).first()["forecast"] == round(3.5)   # half-even -> 4
    const = spark.createDataFrame([(2008 + i, 7) for i in range(6)], "year int, frequency long")
    assert se.yearly_trend_forecast(const).first()["forecast"] == 7
    empty = spark.createDataFrame([], "year int, frequency long")
    assert se.yearly_trend_forecast(empty).first()["forecast"] == 0


def test_strict_parse_fails_coerce_nulls(spark):
    # T9
    df = spark.createDataFrame([("2020-01-02 03:04:05",), ("2020/01/02 03:04",), ("junk",), (None,)], "t string")
    co = df.select(parse_datetime_coerce(F.col("t")).alias("d")).collect()
    assert [r["d"] is None for r in co] == [False, False, True, True]
    with pytest.raises(Exception):
        df.select(parse_datetime_strict(F.col("t"))).collect()
    ok = df.where(F.col("t") != "junk").select(parse_datetime_strict(F.col("t")).alias("d")).collect()
    assert len(ok) == 2


def test_numeric_coerce_nan_to_null(spark):
    df = spark.createDataFrame([("1.5",), ("N/A",), ("NaN",)], "m string")
    got = [r["x"] for r in df.select(to_numeric_coerce(F.col("m")).alias("x")).collect()]
    assert got == [1.5, None, None]


def test_cell_counts_nonnull_magnitude_and_hotspot_ties(spark):
    # T13 + T7: count non-null magnitudes; ties broken by (lat, lon)
    rows = [(0.1, 0.1, 3.0), (0.1, 0.1, None), (1.1, 1.1, 4.0), (-1.1, 2.1, 5.0), (None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "latitude double, longitude double, magnitude double")
    cells = {(r["lat_bin"], r["lon_bin"]): r["count"] for r in sp.cell_aggregate(df).collect()}
    assert cells == {(0.0, 0.0): 1, (1.0, 1.0): 1, (-1.0, 2.0): 1}
    top = sp.hotspots_frequency(df, top_k=2).collect()
    assert [(r["lat"], r["lon"]) for r in top] == [(-1.0, 2.0), (0.0, 0.0)]
    assert all(r["historical_count"] == r["count"] and r["month"] is None for r in top)


def test_cell_series_min_years_rule(spark):
    # T14: a cell passes the >= 3 years rule with a year outside the span
    rows = [(0.0, 0.0, 3.0, y) for y in (2007, 2010, 2011)] + [(5.0, 5.0, 3.0, y) for y in (2010, 2011)]
    df = spark.createDataFrame(rows, "latitude double, longitude double, magnitude double, year int")
    s = se.cell_year_series(df).collect()
    assert len(s) == 1 and s[0]["n_years"] == 3 and s[0]["historical_count"] == 2
    assert len(s[0]["series"]) == 18


def test_heat_weights_bounds(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"latitude": rng.uniform(-5, 5, 300), "longitude": rng.uniform(100, 110, 300),
                        "magnitude": rng.uniform(2, 6, 300)})
    w = sp.heat_weights(spark.createDataFrame(pdf)).toPandas()["weight"]
    assert (w > 0).all() and (w <= 1.0 + 1e-12).all()


def test_hot_cell_and_hot_year_stay_exact(spark):
    """One cell and one year hold a third of the rows: results equal pandas."""
    rng = np.random.default_rng(9)
    n = 3000
    lat = rng.uniform(-10, 5, n)
    lon = rng.uniform(95, 140, n)
    year = rng.integers(2008, 2026, n)
    hot_cell = np.arange(n) % 3 == 0
    lat[hot_cell], lon[hot_cell] = -2.4, 121.1
    year[np.arange(n) % 3 == 1] = 2015
    pdf = pd.DataFrame({"latitude": lat, "longitude": lon, "magnitude": rng.uniform(2, 6, n),
                        "year": year.astype(int)})
    df = spark.createDataFrame(pdf).repartition(7)
    got = {(r["lat_bin"], r["lon_bin"]): r["count"] for r in sp.cell_aggregate(df).collect()}
    cells = pdf.assign(a=np.rint(pdf.latitude / 0.5) * 0.5 + 0.0, b=np.rint(pdf.longitude / 0.5) * 0.5 + 0.0)
    want = cells.groupby(["a", "b"]).size().to_dict()
    assert got == want
    med = {r["year"]: r["median"] for r in ex.year_magnitude_stats(df).collect()}
    for y, g in pdf.groupby("year"):
        assert abs(med[y] - g.magnitude.median()) < 1e-12
    ser = {(r["lat_bin"], r["lon_bin"]): r["historical_count"] for r in se.cell_year_series(df).collect()}
    assert ser[(-2.5, 121.0)] == want[(-2.5, 121.0)]


def test_degenerate_inputs_do_not_fail_under_ansi(spark):
    """Zero denominators (constant values, coincident points) give null or 0,
    never a division-by-zero error (ANSI mode is on by default)."""
    from sismo.operators import silhouette as sil
    const = spark.createDataFrame([(1.0,)] * 5, "v double")
    k = ex.kde_1d(const, "v").collect()
    assert len(k) == 200 and all(r["density"] is None for r in k)
    zero = spark.createDataFrame([(0.1, 0.1, 0.0), (3.1, 3.1, 0.0)],
                                 "latitude double, longitude double, magnitude double")
    assert sp.heat_weights(zero).count() == 2
    same = spark.createDataFrame([(2010, i, i % 2, 1.0, 1.0) for i in range(6)],
                                 "year int, pos long, cluster_label int, a double, b double")
    assert sil.silhouette_by_year(same, ["a", "b"]).first()["silhouette"] == 0.0
    assert sil.silhouette_by_year_fast(same, ["a", "b"]).first()["silhouette"] == 0.0


def test_map_bounds_variants(spark):
    pts = spark.createDataFrame([(-2.5, 121.0), (1.0, 100.0)], "lat double, lon double")
    b = sp.map_bounds(pts, "lat", "lon", pad_cells=3).first()
    assert (b["min_lat"], b["max_lat"], b["min_lon"], b["max_lon"]) == (-4.0, 2.5, 98.5, 122.5)
    empty = pts.where("lat > 100")
    d = sp.map_bounds(empty, "lat", "lon").first()
    assert (d["min_lat"], d["max_lat"], d["min_lon"], d["max_lon"]) == (-11.0, 6.0, 95.0, 141.0)
    c = sp.map_bounds(empty, "lat", "lon", pad_cells=3, center=(-5.0, 115.0)).first()
    assert (c["min_lat"], c["max_lat"], c["min_lon"], c["max_lon"]) == (-10.0, 0.0, 110.0, 120.0)


def test_large_topk_and_sample_are_exact(spark):
    from sismo.operators import topk as tk
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"event_id": np.arange(5000), "magnitude": np.round(rng.uniform(2, 7, 5000), 1)})
    df = spark.createDataFrame(pdf).repartition(6)
    got = tk.top_magnitude_markers(df, 100).toPandas()
    want = pdf.sort_values(["magnitude", "event_id"], ascending=[False, True]).head(100)
    assert sorted(got["event_id"]) == sorted(want["event_id"]) and list(got.columns) == list(df.columns)
    assert tk.top_magnitude_markers(df, 9000).count() == 5000
    s1 = tk.sample_exact_n(df, 50).toPandas()["event_id"].tolist()
    full = df.orderBy(tk.sample_key(), "event_id").limit(50).toPandas()["event_id"].tolist()
    assert sorted(s1) == sorted(full) and len(s1) == 50


def test_depth_bounds_truncate_toward_zero(spark):
    df = spark.createDataFrame([(2020, 5.0, -1.5), (2020, 5.0, -0.5), (2020, 5.0, 9.5), (2020, 5.0, 9.0)],
                               "year int, magnitude double, depth double")
    kept = flt.explore_filter(df, truncate_bounds=True)
    assert sorted(r.depth for r in kept.collect()) == [-0.5, 9.0]


def test_interpolation_over_batches_and_partitions(spark):
    """Long runs of nulls across Arrow batches and range partitions."""
    rng = np.random.default_rng(12)
    n = 700
    a, b = rng.normal(size=n), rng.normal(size=n)
    a[rng.random(n) < 0.4] = np.nan
    b[50:420] = np.nan
    b[:7] = np.nan
    a[-9:] = np.nan
    pdf = pd.DataFrame({"event_id": np.arange(n), "a": a, "b": b, "t": ["x"] * n})
    df = spark.createDataFrame([(int(i), None if np.isnan(x) else float(x), None if np.isnan(y) else float(y), t)
                                for i, x, y, t in pdf.itertuples(index=False)], "event_id long, a double, b double, t string").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
        got = od.interpolate_linear(df, ["a", "b"], order=[F.col("event_id").asc()], partitions=4).orderBy("event_id").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got["pos"].tolist() == list(range(n)) and list(got.columns) == ["event_id", "a", "b", "t", "pos"]
    for c in "ab":
        np.testing.assert_allclose(got[c].to_numpy(dtype=float), pdf[c].interpolate(limit_direction="forward").to_numpy(), atol=1e-12)


@pytest.mark.parametrize("parts", [1, 3])
def test_interpolate_gaps_longer_than_a_window(spark, parts):
    import pandas as pd
    n = 400
    rnd = np.random.default_rng(8)
    a, b = rnd.normal(size=n), rnd.normal(size=n)
    a[17:160], a[161:240], a[390:] = np.nan, np.nan, np.nan
    b[:90], b[100:102], b[200:] = np.nan, np.nan, np.nan
    pdf = pd.DataFrame({"event_id": np.arange(n), "a": a, "b": b, "none": np.full(n, np.nan)})
    df = spark.createDataFrame(pdf).selectExpr("event_id", *(f"nanvl({c}, null) as {c}" for c in ("a", "b", "none")))
    cols = ["a", "b", "none"]
    got = od.interpolate_linear(df, cols, order=[F.col("event_id").asc()], partitions=parts, window_rows=8).orderBy("event_id").toPandas()
    assert got["pos"].tolist() == list(range(n))
    for c in cols:
        np.testing.assert_allclose(got[c].to_numpy(dtype=float), pdf[c].interpolate(limit_direction="forward").to_numpy(), atol=1e-12)


def test_interpolate_holds_no_more_than_a_window():
    import tracemalloc

    import pyarrow as pa

    def batches():
        for i in range(300):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i * 10_000, (i + 1) * 10_000)), pa.nulls(10_000, pa.float64())], names=[od.MID, "v"])
    pool = pa.default_memory_pool()
    most = 0
    tracemalloc.start()
    for out in od._neighbours(["v"], 1 << 16)(batches()):
        most = max(most, pool.bytes_allocated() + tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert most < 60e6 and out.column(out.schema.get_field_index("_gap_v"))[0].as_py() == 0
