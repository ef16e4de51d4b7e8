"""End-to-end compositions of the three reference entry points.

Each returns named DataFrames. Ordering and iterative fits run jobs when
called and leave tables in the scratch folder that the frames read; call
``session.release_scratch`` when the results have been written.


* :func:`anomaly_scan` — catalogue -> interpolate (time order) -> distinct
  features -> standard scale -> reconstruction error -> threshold -> flags,
  counts, histogram, top anomalies;
* :func:`yearly_clustering` — catalogue -> interpolate -> dedupe keeping the
  first year -> scale -> latent encoding -> K-Means per year -> silhouettes,
  dominant labels, cluster statistics;
* :func:`next_year_hotspots` — catalogue -> prediction cleaning -> cell
  series -> forecast (learned, with frequency fallback) -> chart table,
  history summary, forecast delta, heat weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anomaly as an
from ..operators import explore as ex
from ..operators import filters as flt
from ..operators import forecast as fc
from ..operators import kmeans as km
from ..operators import net
from ..operators import ordering as od
from ..operators import pca
from ..operators import scale as sc
from ..operators import series as se
from ..operators import silhouette as sil
from ..operators import spatial as sp
from ..operators import topk as tk
from ..schema import AE_LATENT_LAYER, FALLBACK_THRESHOLD, FEATURES, N_CLUSTERS, TOP_K

F4 = list(FEATURES)
ZF = [f"z_{c}" for c in F4]


def _features(catalog: DataFrame) -> DataFrame:
    """Time-ordered interpolated features, first occurrence of each distinct
    feature row (with its year and position), complete rows only."""
    interp = od.interpolate_linear(flt.add_year_month(catalog), F4)
    return od.dedupe_keep_first(interp, F4).dropna(subset=F4)


def anomaly_scan(catalog: DataFrame, params=None, components: int = 2) -> dict[str, DataFrame]:
    """Batch anomaly scan with the given network weights, or with a linear
    autoencoder (MLlib PCA) when there are none."""
    feats = _features(catalog)
    x = sc.standard_scale(feats, sc.fit_standard(feats), "z_")
    scored = net.score_arrow(x, params, ZF) if params is not None else pca.pca_reconstruct_error(x, ZF, components)
    flagged = an.anomaly_report(scored)
    return {"scored": flagged, "threshold": an.anomaly_threshold(scored),
            "counts": an.anomaly_counts(flagged),
            "histogram": ex.histogram_equal_width(scored, an.ERR),
            "top": tk.top_k(flagged, an.ERR, 10, tie=("pos",))}


def saved_threshold(scored: DataFrame | None = None) -> float:
    """The threshold fitted on ``scored``; the one saved with the original
    model when there is nothing to fit it on."""
    value = None if scored is None else an.anomaly_threshold(scored).first()["threshold"]
    return FALLBACK_THRESHOLD if value is None else float(value)


def yearly_clustering(catalog: DataFrame, params=None, k: int = N_CLUSTERS,
                      exact_silhouette: bool = False) -> dict[str, DataFrame]:
    """Per-year K-Means on the encoder's latent layer (or on the scaled
    features when no encoder is given). The silhouette is the linear-time one
    unless the exact one, quadratic in a year's rows, is asked for."""
    feats = _features(catalog)
    x = sc.standard_scale(feats, sc.fit_standard(feats), "z_")
    if params is not None:
        x = net.score_arrow(x, params, ZF, mode="latent", upto=AE_LATENT_LAYER)
        cols = [c for c in x.columns if c.startswith("latent_feature_")]
    else:
        cols = ZF
    labelled, _ = km.kmeans_by_year(x, cols, k=k)
    table = labelled.select("pos", "year", "cluster_label", *F4, *[c for c in cols if c not in ZF][:5])
    scores = (sil.silhouette_by_year(labelled, cols) if exact_silhouette
              else sil.silhouette_by_year_fast(labelled, cols))
    return {"clusters": table, "silhouette": scores, "summary": sil.silhouette_summary(scores),
            "dominant": km.dominant_cluster(labelled), "stats": km.cluster_stats(table)}


def next_year_hotspots(catalog: DataFrame, model=None, top_k: int = TOP_K,
                       method: str = "trend") -> dict[str, DataFrame]:
    """Next-year hotspot ranking (learned when ``model`` is given, frequency
    otherwise) with the yearly chart and its summaries."""
    clean = flt.prediction_clean(catalog)
    points, used = fc.hotspots_forecast_or_frequency(clean, model, top_k)
    chart = se.forecast_chart_table(clean, method)
    return {"hotspots": points.withColumn("method", F.lit(used)), "chart": chart,
            "history": se.history_summary(chart), "delta": se.forecast_delta(chart),
            "heat": sp.heat_weights(clean)}
