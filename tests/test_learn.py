"""Learned operators against brute-force numpy on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sismo.operators import anomaly as an
from sismo.operators import kmeans as km
from sismo.operators import net
from sismo.operators import scale as sc
from sismo.operators import silhouette as sil
from sismo.operators.pca import pca_reconstruct_error


def _blobs(n_per=40, years=(2010, 2011, 2012), seed=0):
    rng = np.random.default_rng(seed)
    rows, pos = [], 0
    for y in years:
        for c in ((0, 0, 0), (4, 4, 1)):
            for _ in range(n_per):
                rows.append((y, pos, *(np.array(c, float) + rng.normal(scale=0.5, size=3))))
                pos += 1
    return pd.DataFrame(rows, columns=["year", "pos", "a", "b", "c"])


def _lloyd_np(x, pos, k):
    order = np.argsort(pos)
    x, pos = x[order], pos[order]
    cs = [x[0]]
    for _ in range(1, k):
        d = np.min([((x - c) ** 2).sum(1) for c in cs], axis=0)
        best = max(range(len(x)), key=lambda i: (d[i], -pos[i]))
        cs.append(x[best])
    cs = np.array(cs)
    while True:
        lab = np.argmin([((x - c) ** 2).sum(1) for c in cs], axis=0)
        new = np.array([x[lab == j].mean(0) if (lab == j).any() else cs[j] for j in range(k)])
        if np.abs(new - cs).max() <= 1e-9:
            break
        cs = new
    cs = cs[np.lexsort(cs.T[::-1])]
    lab = np.argmin([((x - c) ** 2).sum(1) for c in cs], axis=0)
    return cs, lab, pos


@pytest.mark.parametrize("hint", [km.DRIVER_NUMBERS, 0])
def test_kmeans_matches_numpy_lloyd(spark, monkeypatch, hint):
    monkeypatch.setattr(km, "DRIVER_NUMBERS", hint)
    pdf = _blobs()
    pdf.loc[pdf.index % 3 == 0, ["a", "b"]] += 1.7        # several updates until nothing moves
    df = spark.createDataFrame(pdf)
    labelled, res = km.kmeans_by_year(df, ["a", "b", "c"], k=2)
    got, centres = labelled.toPandas(), {r["year"]: r["_c"] for r in res.centres.collect()}
    assert res.updates > 2 and sorted(got.columns) == sorted([*pdf.columns, "cluster_label"])
    for y, g in pdf.groupby("year"):
        cs, lab, pos = _lloyd_np(g[["a", "b", "c"]].to_numpy(), g["pos"].to_numpy(), 2)
        np.testing.assert_allclose(np.array(centres[y]), cs, atol=1e-9)
        gl = got[got.year == y].set_index("pos").loc[pos, "cluster_label"].to_numpy()
        assert (gl == lab).all()
    table = res.centres_frame(labelled).toPandas()
    assert table["n"].sum() == len(pdf) and len(table) == 6


def test_kmeans_skips_small_groups(spark):
    pdf = pd.DataFrame({"year": [2010, 2011, 2011], "pos": [0, 1, 2], "a": [1.0, 2.0, 3.0]})
    lab, res = km.kmeans_by_year(spark.createDataFrame(pdf), ["a"], k=2)
    assert [r["year"] for r in res.centres.collect()] == [2011]
    assert lab.count() == 2


def _silhouette_np(x, lab, squared=False):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    if squared:
        d = d ** 2
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == l].mean() for l in np.unique(lab) if l != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


@pytest.mark.parametrize("block_rows", [7, 2048])
def test_exact_silhouette_blockwise(spark, block_rows):
    pdf = _blobs(n_per=25)
    pdf["cluster_label"] = (pdf["a"] > 2).astype(int)
    pdf.loc[0, "cluster_label"] = 2       # a singleton cluster contributes 0
    got = sil.silhouette_by_year(spark.createDataFrame(pdf), ["a", "b", "c"], block_rows=block_rows).toPandas()
    for _, r in got.iterrows():
        g = pdf[pdf.year == r["year"]]
        want = _silhouette_np(g[["a", "b", "c"]].to_numpy(), g["cluster_label"].to_numpy())
        assert abs(r["silhouette"] - want) < 1e-9


@pytest.mark.parametrize("rows", [10_000, 340_000, 2_000_000])
def test_rows_are_sent_to_a_bounded_number_of_tiles(spark, rows):
    """Larger groups get larger blocks, not more of them."""
    sizes = spark.createDataFrame([(y, rows) for y in range(2008, 2026)] + [(1900, 3)], "year int, n long")
    nb = {r["year"]: r["nb"] for r in sil._blocks(sizes, "year", 2048).collect()}
    assert nb[1900] == 1 and max(nb.values()) <= 8
    hot = sil._blocks(spark.createDataFrame([(2010, rows)], "year int, n long"), "year", 2048).first()["nb"]
    assert (5 if rows == 10_000 else 20) <= hot <= 2 * (sil.TILES / 2) ** 0.5 + 1


def test_tiles_keep_the_digits_of_near_rows(spark):
    """Rows a millionth apart far from the origin, coincident rows, and more
    rows than one square; each pair of blocks is measured once."""
    rng = np.random.default_rng(8)
    n = 700
    x = 1e6 + rng.normal(size=(n, 2)) * np.where(np.arange(n) % 3, 1e-3, 50.0)[:, None]
    x[::7] = x[0]
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(year=2010, pos=np.arange(n), cluster_label=(np.arange(n) % 5 // 2))
    for block_rows in (300, 2048):
        got = sil.mean_distance_to_labels(spark.createDataFrame(pdf), ["a", "b"], block_rows=block_rows).toPandas()
        dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        lab = pdf["cluster_label"].to_numpy()
        assert len(got) == n * 3 and (got["own"] == lab[got["pos"]]).all()
        for k in range(3):
            g = got[got["label"] == k].sort_values("pos")
            assert (g["cnt"] == (lab == k).sum()).all()
            np.testing.assert_allclose(g["sum_d"], dist[:, lab == k].sum(axis=1), rtol=1e-9)


def test_features_are_written_before_they_are_read_again(spark, monkeypatch):
    from sismo.plans import q_learn
    rows = spark.createDataFrame([(i, 2010 + i % 2, *[float(v) if v >= 0 else None for v in (i % 4, i % 3, 1, i % 5 - 1)]) for i in range(60)],
                                 "pos long, year int, magnitude double, depth double, latitude double, longitude double")
    monkeypatch.setattr(q_learn, "interp", lambda spark, sf: rows)
    d = q_learn.dedup(spark, "")
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    want = {r[2:] for r in rows.dropna().collect()}
    assert d.count() == len(want) and {tuple(r[c] for c in q_learn.F4) for r in d.collect()} == want


def test_fast_silhouette_is_squared_variant(spark):
    pdf = _blobs(n_per=20)
    pdf["cluster_label"] = (pdf["a"] > 2).astype(int)
    got = sil.silhouette_by_year_fast(spark.createDataFrame(pdf), ["a", "b", "c"]).toPandas()
    for _, r in got.iterrows():
        g = pdf[pdf.year == r["year"]]
        want = _silhouette_np(g[["a", "b", "c"]].to_numpy(), g["cluster_label"].to_numpy(), squared=True)
        assert abs(r["silhouette"] - want) < 1e-7


def test_silhouette_null_for_one_label(spark):
    pdf = _blobs(n_per=5, years=(2010,))
    pdf["cluster_label"] = 0
    got = sil.silhouette_by_year(spark.createDataFrame(pdf), ["a", "b", "c"]).first()
    assert got["silhouette"] is None


def test_dominant_cluster_ties_to_lower_label(spark):
    df = spark.createDataFrame([(2010, 1), (2010, 0), (2011, 1), (2011, 1), (2011, 0)],
                               "year int, cluster_label int")
    d = {r["year"]: (r["dominant_label"], r["count"], r["total"]) for r in km.dominant_cluster(df).collect()}
    assert d == {2010: (0, 1, 2), 2011: (1, 2, 3)}


def test_scoring_paths_agree(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(200, 4)), columns=list("abcd")))
    params = net.rule_params((4, 8, 2, 8, 4))
    a = net.score_arrow(df, params, list("abcd")).orderBy("a").toPandas()
    b = net.reconstruction_error_columns(df, params, list("abcd")).orderBy("a").toPandas()
    np.testing.assert_allclose(a["reconstruction_error"], b["reconstruction_error"], rtol=1e-9)


def test_anomaly_flag_strictly_above(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 1, 1, 1, 1, 1, 10]],
                               "reconstruction_error double")
    thr = an.anomaly_threshold(df).first()["threshold"]
    flagged = an.classify_anomaly(df, thr).toPandas()
    assert flagged["is_anomaly"].sum() == (flagged["reconstruction_error"] > thr).sum()
    eq = an.classify_anomaly(df, 10.0).toPandas()
    assert eq["is_anomaly"].sum() == 0


def test_pca_error_zero_for_rank_deficient(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(200, 2))
    x = np.c_[z, z @ np.array([[1.0, 0.5], [0.2, -1.0]])]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")))
    e = pca_reconstruct_error(df, list("abcd"), k=2).agg(F.max("reconstruction_error")).first()[0]
    assert e < 1e-6


def test_pca_identities_hold_for_the_rows_it_was_fitted_on(spark):
    from sismo.operators import pca
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3)) + 5.0
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    for k in (1, 2, 3):
        fit = pca.fit_pca(df, list("abc"), k, centred=False)
        r = pca.identities(pca.pca_reconstruct_error(df, list("abc"), fit=fit), list("abc"), fit).first()
        assert r["n"] == 300 and r["eigen_residual"] < 1e-8 and r["error_residual"] < 1e-8
        assert abs(r["total_variance"] - x.var(axis=0, ddof=1).sum()) < 1e-8


@pytest.mark.parametrize("k", [1, 3])
def test_delta_lloyd_and_table_of_centres_agree(spark, monkeypatch, k):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"year": rng.integers(2000, 2004, 900), "pos": np.arange(900), "a": rng.random(900), "b": rng.random(900) * 3})
    pdf.loc[pdf.year == 2003, "a"] = 1.0  # a group that settles at once
    df = spark.createDataFrame(pdf).repartition(3)
    monkeypatch.setattr(km, "ANEW", 0.05)  # the table is labelled anew more than once
    got = []
    for most in (km.DRIVER_NUMBERS, 0):
        monkeypatch.setattr(km, "DRIVER_NUMBERS", most)
        lab, res = km.kmeans_by_year(df, ["a", "b"], k=k)
        got.append(sorted((r.pos, r.cluster_label) for r in lab.collect()))
        assert k == 1 or res.updates > 4
    assert got[0] == got[1]
    for y, g in pdf.groupby("year"):
        _, lab, pos = _lloyd_np(g[["a", "b"]].to_numpy(), g["pos"].to_numpy(), k)
        assert {p: x for p, x in got[0] if p in set(pos)} == dict(zip(pos, lab))


def test_scoring_leaves_other_columns_alone(spark):
    params = net.rule_params((2, 3, 2))
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, 1.0, 2.0, ["x"]), (None, None, 2.0, None)], "event_id long, a double, b double, tags array<string>")
    rows = net.score_arrow(df, params, ["a", "b"]).collect()
    assert rows[0].event_id == big and rows[0].tags == ["x"] and rows[0].reconstruction_error is not None
    assert rows[1].event_id is None and rows[1].reconstruction_error is None


def test_models_by_key(spark, monkeypatch):
    rows = [(y, float(i), float(i * (y or 3) % 7)) for y in (1, 2, None) for i in range(5)] + [(3, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "year int, a double, b double")
    got = []
    for most in (sc.MODEL_NUMBERS, 0):
        monkeypatch.setattr(sc, "MODEL_NUMBERS", most)
        got.append(sorted(map(str, sc.scale_by_model(df, sc.standard_stats_by(df, "year", ["a", "b"]), "year", ["a", "b"]).collect())))
    assert got[0] == got[1] and len(got[0]) == len(rows)
    pdf = pd.DataFrame(rows, columns=["year", "a", "b"])
    want = pdf.groupby("year", dropna=False)["a"].transform(lambda v: (v - v.mean()) / (v.std(ddof=0) or 1))
    assert sorted(round(x, 9) for x in want) == sorted(round(float(s.split("a=")[1].split(",")[0]), 9) for s in got[0])


def test_one_fit_serves_every_number_of_components(spark, monkeypatch):
    from sismo.operators import pca
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(60, 3)) * [1, 2, 3] + 1, columns=list("abc")))
    apart = [pca.fit_pca(df, list("abc"), k, centred=False) for k in (1, 2, 3)]
    fits, fit = [], pca.PCA.fit
    monkeypatch.setattr(pca.PCA, "fit", lambda self, *a: fits.append(1) or fit(self, *a))
    together = pca.fit_pcas(df, list("abc"), (1, 2, 3), centred=False)
    assert len(fits) == 1
    for x, y in zip(apart, together):
        assert x.k == y.k
        np.testing.assert_allclose(x.components, y.components, atol=1e-12)
        np.testing.assert_allclose([*x.shares, *x.mean], [*y.shares, *y.mean], atol=1e-12)
