"""The three end-to-end flows on the smallest tables."""

from sismo.operators import filters as flt
from sismo.operators import forecast as fc
from sismo.operators import net
from sismo.plans import flows
from sismo.sources.fixtures import catalog

from conftest import SF_SMALL


def test_anomaly_scan_with_fixed_weights(spark):
    out = flows.anomaly_scan(catalog(spark, SF_SMALL), params=net.rule_params((4, 6, 3, 6, 4)))
    c = out["counts"].first()
    assert c["normal"] + c["anomalous"] == c["total"] > 0
    assert out["top"].count() == 10
    assert sum(r["count"] for r in out["histogram"].collect()) == c["total"]


def test_yearly_clustering_and_hotspots(spark):
    cat = catalog(spark, SF_SMALL)
    out = flows.yearly_clustering(cat, exact_silhouette=False)
    s = out["summary"].first()
    assert -1.0 <= s["min"] <= s["max"] <= 1.0
    assert out["dominant"].count() == out["silhouette"].count()
    hot = flows.next_year_hotspots(cat, model=fc.WEIGHTED_AVERAGE)
    pts = hot["hotspots"].collect()
    assert len(pts) == 15 and pts[0]["method"] == "Weighted Average"
    counts = [p["count"] for p in pts]
    assert counts == sorted(counts, reverse=True)
    assert hot["chart"].count() == 19


def test_scan_without_weights_and_default_threshold(spark):
    out = flows.anomaly_scan(catalog(spark, SF_SMALL))
    assert out["counts"].first()["anomalous"] > 0
    assert flows.saved_threshold() == 0.0001606588873608411
    assert flows.saved_threshold(out["scored"]) == out["threshold"].first()["threshold"]


def test_no_forecast_names_the_method_used(spark):
    cat = flt.prediction_clean(catalog(spark, SF_SMALL))
    empty = cat.where("event_id < -1000000000")
    assert fc.hotspots_forecast_or_frequency(empty, fc.WEIGHTED_AVERAGE)[1] == "Frequency-Based (Statistik)"
    assert fc.hotspots_forecast_or_frequency(cat, None)[1] == "Frequency-Based (Statistik)"


def test_scratch_tables_go(spark):
    import glob
    from sismo import session
    session.release_scratch(spark)
    root = session.checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/sismo-*"))
    out = flows.yearly_clustering(catalog(spark, SF_SMALL))
    out["summary"].collect()
    assert set(glob.glob(f"{root}/sismo-*")) - before
    session.release_scratch(spark)
    assert set(glob.glob(f"{root}/sismo-*")) <= before
