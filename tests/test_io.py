"""Sources, sinks, reuse logic and stream = batch."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sismo.operators import net
from sismo.operators import scale as sc
from sismo.operators import spatial as sp
from sismo.schema import FEATURES, METHOD_FREQUENCY
from sismo.sources import files as io
from sismo.sources import fixtures as fx
from sismo.streaming.score import score_records, stream_score_records

from conftest import SF_SMALL


def _tmp(name):
    return os.path.join(tempfile.mkdtemp(prefix="sismo-io-"), name)


def test_catalog_fixture_counts(spark):
    cat = fx.catalog(spark, SF_SMALL)
    assert cat.count() == 1019
    assert cat.where(F.col("datetime").isNull()).count() == 6


def _write(lines, name="cat.csv"):
    path = _tmp(name)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_read_catalog_requires_columns(spark):
    path = _write(["datetime,latitude,longitude,depth", "2020-01-01,1,2,3"])
    with pytest.raises(io.MissingColumns):
        io.read_catalog(spark, path)
    with pytest.raises(io.MissingColumns):
        io.read_preprocessed(spark, path)


def test_read_catalog_goes_by_header_names(spark):
    path = _write(["datetime,latitude,longitude,magnitude,depth,location,agency",
                   "2020-01-01 00:00:00,-6.2,106.8,5.1,10,Jakarta,x", "junk,1,2,N/A,,\"a, b\",y"])
    a, b = io.read_catalog(spark, path).orderBy("event_id").collect()
    assert (a.latitude, a.longitude, a.magnitude, a.depth, a.location, a.agency) == (-6.2, 106.8, 5.1, 10.0, "Jakarta", "x")
    assert (b.datetime, b.magnitude, b.depth, b.location) == (None, None, None, "a, b")
    assert a.event_id < b.event_id
    r = io.read_preprocessed(spark, path).collect()
    assert tuple(r[0]) == (5.1, 10.0, -6.2, 106.8)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_mixed_datetimes_keep_their_wall_clock(spark, zone):
    from datetime import datetime as dt
    texts = {"2020-01-01 00:00:00.123456": dt(2020, 1, 1, 0, 0, 0, 123456), "2020-01-01T00:00:00Z": dt(2020, 1, 1),
             "2020-01-01 07:05": dt(2020, 1, 1, 7, 5), "01/02/2020": dt(2020, 1, 2), "2020/03/08 02:30": dt(2020, 3, 8, 2, 30),
             "2020-03-08 02:30:00": dt(2020, 3, 8, 2, 30), "2020-05-01": dt(2020, 5, 1), "12/31/2019 23:59:58.5": dt(2019, 12, 31, 23, 59, 58, 500000)}
    path = _write(["datetime,magnitude,depth,latitude,longitude", *(f"{t},1,2,3,4" for t in texts)])
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        rows = io.read_catalog(spark, path, strict=True).orderBy("event_id").collect()
        assert [r.datetime for r in rows] == list(texts.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_csv_catalog_round_trip(spark):
    path = _tmp("cat.csv")
    io.write_csv(fx.catalog_text(spark, SF_SMALL, junk=True), path)
    back = io.read_catalog(spark, path, "csv")
    want = fx.catalog_parsed(spark, SF_SMALL)
    assert back.exceptAll(want.select(*back.columns)).count() == 0
    assert back.count() == want.count()


def test_prediction_document_round_trip_and_reuse(spark):
    cat = fx.catalog(spark, SF_SMALL).dropna(subset=["latitude", "longitude", "magnitude"])
    pts = sp.hotspots_frequency(cat, top_k=7)
    path = _tmp("pred.json")
    io.write_predictions(pts, METHOD_FREQUENCY, path, k=7)
    back = io.read_predictions(spark, path).orderBy("rank").toPandas()
    want = pts.toPandas()
    assert back["rank"].tolist() == list(range(7))
    assert back["count"].tolist() == want["count"].tolist()
    assert (back["method"] == METHOD_FREQUENCY).all()
    calls = []

    def compute():
        calls.append(1)
        return sp.hotspots_frequency(cat, top_k=7)

    got, reused = io.reuse_predictions(spark, path, METHOD_FREQUENCY, 5, compute)
    assert reused and got.count() == 5 and not calls
    got, reused = io.reuse_predictions(spark, path, METHOD_FREQUENCY, 9, compute)   # too few saved
    assert not reused and calls
    got, reused = io.reuse_predictions(spark, path, "other", 3, compute)
    assert not reused
    assert io.read_predictions(spark, _tmp("missing.json")) is None


def test_indented_and_corrupt_documents(spark):
    import json
    points = [{"lat": 1.0, "lon": 2.0, "count": 3 - i, "historical_count": 3, "mag": 4.5, "year": 2026, "month": None} for i in range(3)]
    path = _tmp("pred.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"method": "m", "hotspot_points": points, "timestamp": "t"}, f, indent=2)
    assert [r["count"] for r in io.read_predictions(spark, path).orderBy("rank").collect()] == [3, 2, 1]
    with open(_tmp("bad.json"), "w", encoding="utf-8") as f:
        f.write('{"method": "m", "hotspot_po')
    assert io.read_prediction_doc(spark, f.name) is None
    with open(_tmp("few.json"), "w", encoding="utf-8") as f:
        f.write("{}")
    assert io.read_prediction_doc(spark, f.name).first()["method"] == "Unknown"


def test_scaler_fit_on_missing_then_load(spark):
    cat = fx.catalog(spark, SF_SMALL).dropna(subset=list(FEATURES))
    path = _tmp("scaler")
    a = io.load_scaler(spark, path, fit=lambda: sc.standard_stats(cat)).collect()
    b = io.load_scaler(spark, path).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_model_weights_round_trip(spark):
    params = net.rule_params((4, 6, 3))
    path = _tmp("model")
    io.save_model(net.weights_table(spark, params), path)
    back = net.params_from_rows(io.load_model(spark, path).collect(), (4, 6, 3))
    for (w0, b0), (w1, b1) in zip(params, back):
        assert (w0 == w1).all() and (b0 == b1).all()


def test_stream_equals_batch(spark):
    cat = fx.catalog(spark, SF_SMALL)
    feats = cat.dropna(subset=list(FEATURES))
    stats = sc.fit_standard(feats)
    params = net.rule_params((4, 6, 3, 6, 4))
    batch = score_records(cat, stats, params, 0.5).toPandas().sort_values("event_id").reset_index(drop=True)
    src, sink, ck = _tmp("in"), _tmp("out"), _tmp("ck")
    cat.repartition(5).write.parquet(src)
    stream_score_records(spark, src, sink, ck, stats, params, 0.5, max_files=2)
    got = spark.read.parquet(sink).toPandas().sort_values("event_id").reset_index(drop=True)
    assert got["event_id"].tolist() == batch["event_id"].tolist()
    assert (got["is_anomaly"] == batch["is_anomaly"]).all()
    assert (abs(got["reconstruction_error"] - batch["reconstruction_error"]) < 1e-12).all()


def test_stream_resumes_from_checkpoint(spark):
    """A restarted stream processes only files it has not seen (progress in
    the checkpoint), so the sink ends with every record exactly once."""
    cat = fx.catalog(spark, SF_SMALL)
    stats = sc.fit_standard(cat.dropna(subset=list(FEATURES)))
    params = net.rule_params((4, 6, 3, 6, 4))
    src, sink, ck = _tmp("in"), _tmp("out"), _tmp("ck")
    cat.where("event_id % 2 = 0").repartition(3).write.parquet(src)
    stream_score_records(spark, src, sink, ck, stats, params, 0.5)
    first = spark.read.parquet(sink).count()
    cat.where("event_id % 2 <> 0").repartition(3).write.mode("append").parquet(src)
    stream_score_records(spark, src, sink, ck, stats, params, 0.5)
    out = spark.read.parquet(sink)
    want = cat.dropna(subset=list(FEATURES)).count()
    assert 0 < first < want
    assert out.count() == want and out.select("event_id").distinct().count() == want


def test_partitioned_export_prunes_by_year(spark):
    df = spark.createDataFrame([(2010, 1, 0), (2011, 2, 1), (2011, 3, 0)], "year int, pos long, cluster_label int")
    path = _tmp("clusters")
    io.write_partitioned(df, path, "year", fmt="parquet")
    back = spark.read.parquet(path).where("year = 2011")
    assert back.count() == 2
    assert "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().executedPlan().toString() \
        or "PartitionFilters" in back._jdf.queryExecution().executedPlan().toString()


def test_scratch_scope_deletes_what_was_written_inside(spark):
    from sismo.session import cut_lineage, scratch_scope
    kept = cut_lineage(spark.range(3))
    with scratch_scope(spark):
        gone = cut_lineage(spark.range(4))
        path = gone.inputFiles()[0].replace("file://", "")
        assert os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3
