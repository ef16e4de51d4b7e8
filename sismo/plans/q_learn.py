"""Registered queries: scaling, network scoring with fixed dyadic weights
(the full 4-64-32-10-32-64-4 autoencoder), anomaly flags, K-Means per year run
to convergence, silhouettes, densities and MLlib PCA."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly as an
from ..operators import kmeans as km
from ..operators import net
from ..operators import ordering as od
from ..operators import scale as sc
from ..operators import silhouette as sil
from ..operators import topk as tk
from ..schema import AE_LATENT_LAYER, AE_LAYERS, AE_VALIDATION, FEATURES
from ..session import cut_lineage, scratch_path
from ..sources import files as io
from .q_explore import interp
from .registry import register
from .sqlkit import R6, build, cte, r6

F4 = list(FEATURES)
ZF = [f"z_{c}" for c in F4]                       # scaled features, beside the raw ones
CHECK_PARAMS = net.rule_params(AE_LAYERS)
N_LATENT = AE_LAYERS[AE_LATENT_LAYER]
LATENTS = [f"latent_feature_{j}" for j in range(N_LATENT)]


# ---------------------------------------------------------------------------
# Spark side building blocks
# ---------------------------------------------------------------------------
def dedup(spark, sf):
    """Distinct interpolated feature rows (first position and year kept),
    rows with a leading-null feature dropped. Written once: what follows reads
    them several times."""
    d = od.dedupe_keep_first(interp(spark, sf))
    return cut_lineage(d.dropna(subset=F4), "features")


def scaled(spark, sf):
    """Raw features with the scaled ones beside them."""
    d = dedup(spark, sf)
    return sc.standard_scale(d, sc.fit_standard(d), "z_")


def scored_fixed(spark, sf):
    return net.score_arrow(scaled(spark, sf), CHECK_PARAMS, ZF)


def encoded(df):
    return net.score_arrow(df, CHECK_PARAMS, ZF, mode="latent", upto=AE_LATENT_LAYER)


def kmeans_fixed(spark, sf):
    """Labelled rows (raw and scaled features) and the fit."""
    return km.kmeans_by_year(scaled(spark, sf), ZF, k=2)


# ---------------------------------------------------------------------------
# SQL side
# ---------------------------------------------------------------------------
cte("feat", """feat AS (SELECT * FROM dedup
  WHERE magnitude IS NOT NULL AND depth IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL),
fstats AS (SELECT avg(magnitude) AS mu0, CASE WHEN stddev_pop(magnitude) = 0 THEN 1.0 ELSE stddev_pop(magnitude) END AS sd0,
  avg(depth) AS mu1, CASE WHEN stddev_pop(depth) = 0 THEN 1.0 ELSE stddev_pop(depth) END AS sd1,
  avg(latitude) AS mu2, CASE WHEN stddev_pop(latitude) = 0 THEN 1.0 ELSE stddev_pop(latitude) END AS sd2,
  avg(longitude) AS mu3, CASE WHEN stddev_pop(longitude) = 0 THEN 1.0 ELSE stddev_pop(longitude) END AS sd3
  FROM feat),
fscaled AS (SELECT f.pos, f.year, f.magnitude AS m_raw, f.depth AS d_raw, f.latitude AS lat_raw, f.longitude AS lon_raw,
  (f.magnitude - s.mu0) / s.sd0 AS magnitude, (f.depth - s.mu1) / s.sd1 AS depth,
  (f.latitude - s.mu2) / s.sd2 AS latitude, (f.longitude - s.mu3) / s.sd3 AS longitude
  FROM feat f, fstats s)""", ("dedup",))


def _net_sql(src: str, params, in_cols, name: str, upto: int | None = None) -> str:
    """CTE chain ``{name}0..`` computing the forward pass; the last CTE is
    ``{name}`` with columns ``{name}_0..``."""
    n = len(params)
    stop = n if upto is None else upto
    cur = list(in_cols)
    parts = []
    prev = src
    for li in range(stop):
        w, b = params[li]
        cols = []
        for j in range(w.shape[1]):
            terms = " + ".join(f"{cur[i]} * {float(w[i, j])!r}" for i in range(len(cur)))
            z = f"(({terms}) + {float(b[j])!r})"
            cols.append(f"{'greatest(' + z + ', 0.0)' if li < n - 1 else z} AS _{name}{li}_{j}")
        parts.append(f"{name}{li} AS (SELECT *, {', '.join(cols)} FROM {prev})")
        prev = f"{name}{li}"
        cur = [f"_{name}{li}_{j}" for j in range(w.shape[1])]
    outs = ", ".join(f"{c} AS {name}_{j}" for j, c in enumerate(cur))
    parts.append(f"{name} AS (SELECT *, {outs} FROM {prev})")
    return ",\n".join(parts)


cte("recnet", _net_sql("fscaled", CHECK_PARAMS, F4, "rn"), ("feat",))
_err_terms = " + ".join(f"(rn_{j} - {c}) * (rn_{j} - {c})" for j, c in enumerate(F4))
cte("scored", f"""scored AS (SELECT pos, year, m_raw, d_raw, magnitude, depth, latitude, longitude,
  ({_err_terms}) / 4.0 AS err FROM rn),
thr AS (SELECT avg(err) + 3.0 * stddev_pop(err) AS threshold, avg(err) AS mean_error,
  stddev_pop(err) AS std_error FROM scored),
flagged AS (SELECT s.*, CAST(s.err > t.threshold AS INTEGER) AS is_anomaly FROM scored s, thr t)""",
    ("recnet",))
cte("encnet", _net_sql("fscaled", CHECK_PARAMS, F4, "en", upto=AE_LATENT_LAYER), ("feat",))


def _km_sql(src: str = "fscaled", fs=tuple(F4), name: str = "", k: int = 2) -> str:
    """Twin of ``kmeans_by_group``: farthest-point init, Lloyd updates as a
    recursive CTE until no centre of a group moves, canonical relabelling,
    final assignment (``{name}km_lab``, centres ``{name}c_rank``)."""
    d = len(fs)

    def sqd(x: str, c: str, j: int) -> str:
        return " + ".join(f"({x}.{f} - {c}.a{j}_{i}) * ({x}.{f} - {c}.a{j}_{i})" for i, f in enumerate(fs))

    def least(items: list[str]) -> str:
        return items[0] if len(items) == 1 else f"least({', '.join(items)})"

    n = name
    parts = [f"""{n}km_in AS MATERIALIZED (SELECT * FROM {src} WHERE year IS NOT NULL
  AND year IN (SELECT year FROM {src} GROUP BY year HAVING count(*) >= {k}))""",
             f"""{n}c_init0 AS (SELECT year, {', '.join(f'arg_min({f}, pos) AS a0_{i}' for i, f in enumerate(fs))}
  FROM {n}km_in GROUP BY year)"""]
    prev = f"{n}c_init0"
    for j in range(1, k):
        near = least([f"({sqd('x', 'p', q)})" for q in range(j)])
        keep = ", ".join(f"p.a{q}_{i}" for q in range(j) for i in range(d))
        keep_plain = ", ".join(f"a{q}_{i}" for q in range(j) for i in range(d))
        parts.append(f"""{n}c_init{j}r AS (SELECT x.*, {keep},
  row_number() OVER (PARTITION BY x.year ORDER BY {near} DESC, x.pos) AS rn
  FROM {n}km_in x JOIN {prev} p ON x.year = p.year)""")
        parts.append(f"""{n}c_init{j} AS (SELECT year, {keep_plain},
  {', '.join(f'{f} AS a{j}_{i}' for i, f in enumerate(fs))} FROM {n}c_init{j}r WHERE rn = 1)""")
        prev = f"{n}c_init{j}"
    cells = [(j, i) for j in range(k) for i in range(d)]

    def labelled(centres: str, where: str = "") -> str:
        ds = [f"({sqd('x', 'c', j)})" for j in range(k)]
        lst = least(ds)
        case = " ".join(f"WHEN {ds[j]} = {lst} THEN {j}" for j in range(k))
        return f"SELECT x.*, c.* EXCLUDE (year), CASE {case} END AS lab FROM {n}km_in x JOIN {centres} c ON x.year = c.year{where}"

    old = ", ".join(f"any_value(a{j}_{i}) AS a{j}_{i}" for j, i in cells)
    means = ", ".join(f"coalesce(avg({fs[i]}) FILTER (WHERE lab = {j}), any_value(a{j}_{i})) AS m{j}_{i}" for j, i in cells)
    moved = " OR ".join(f"abs(m{j}_{i} - a{j}_{i}) > 1e-9" for j, i in cells)
    nxt = ", ".join(f"CASE WHEN moved THEN m{j}_{i} ELSE a{j}_{i} END AS a{j}_{i}" for j, i in cells)
    parts.append(f"""{n}c_all(it, moved, year, {', '.join(f'a{j}_{i}' for j, i in cells)}) AS (
  SELECT 0, true, year, {', '.join(f'a{j}_{i}' for j, i in cells)} FROM {prev}
  UNION ALL
  SELECT it + 1, moved, year, {nxt} FROM (
    SELECT *, {moved} AS moved FROM (
      SELECT any_value(it) AS it, year, {old}, {means} FROM ({labelled(n + 'c_all', ' WHERE c.moved')}) GROUP BY year)))""")
    longs = " UNION ALL ".join(
        f"SELECT year, [{', '.join(f'a{j}_{i}' for i in range(d))}] AS v FROM {n}c_all WHERE NOT moved" for j in range(k))
    piv = ", ".join(f"max(CASE WHEN canon = {j} THEN v[{i + 1}] END) AS a{j}_{i}" for j, i in cells)
    parts.append(f"""{n}c_rank AS (SELECT year, v, row_number() OVER (PARTITION BY year ORDER BY v) - 1 AS canon FROM ({longs}))""")
    parts.append(f"{n}c_final AS (SELECT year, {piv} FROM {n}c_rank GROUP BY year)")
    parts.append(f"{n}km_lab AS ({labelled(n + 'c_final')})")
    return ",\n".join(parts)


cte("kmeans", _km_sql(), ("feat",))


# ---------------------------------------------------------------------------
# 2.4 scaling
# ---------------------------------------------------------------------------
@register("standard_scale", build(f"""SELECT pos, year, {R6('magnitude')} AS magnitude, {R6('depth')} AS depth,
  {R6('latitude')} AS latitude, {R6('longitude')} AS longitude FROM fscaled""", "feat"))
def q_standard_scale(spark, sf):
    return scaled(spark, sf).select("pos", "year", *[r6(z).alias(c) for c, z in zip(F4, ZF)])


@register("minmax_scale", build("""SELECT pos, year,
  (magnitude - (SELECT min(magnitude) FROM feat)) / ((SELECT max(magnitude) FROM feat) - (SELECT min(magnitude) FROM feat)) AS magnitude,
  (depth - (SELECT min(depth) FROM feat)) / ((SELECT max(depth) FROM feat) - (SELECT min(depth) FROM feat)) AS depth,
  (latitude - (SELECT min(latitude) FROM feat)) / ((SELECT max(latitude) FROM feat) - (SELECT min(latitude) FROM feat)) AS latitude,
  (longitude - (SELECT min(longitude) FROM feat)) / ((SELECT max(longitude) FROM feat) - (SELECT min(longitude) FROM feat)) AS longitude
FROM feat""", "feat"))
def q_minmax_scale(spark, sf):
    d = dedup(spark, sf)
    return sc.minmax_scale(d, sc.fit_minmax(d)).select("pos", "year", *F4)


# ---------------------------------------------------------------------------
# 2.9 network scoring (fixed dyadic weights) and anomaly flags
# ---------------------------------------------------------------------------
@register("reconstruct_error", build(f"SELECT pos, {R6('err')} AS reconstruction_error FROM scored", "scored"))
def q_reconstruct_error(spark, sf):
    s = scored_fixed(spark, sf)
    return s.select("pos", r6("reconstruction_error").alias("reconstruction_error"))


_LAT_SQL = ", ".join(f"{R6(f'en_{j}')} AS latent_feature_{j}" for j in range(N_LATENT))


def _lat(n=N_LATENT):
    return [r6(c).alias(c) for c in LATENTS[:n]]


@register("encode_latent", build(f"SELECT pos, {_LAT_SQL} FROM en", "encnet"))
def q_encode_latent(spark, sf):
    return encoded(scaled(spark, sf)).select("pos", *_lat())


@register("attach_latents", build(f"SELECT pos, year, m_raw AS magnitude, d_raw AS depth, {_LAT_SQL} FROM en", "encnet"))
def q_attach_latents(spark, sf):
    """Features and latents saved apart, in files of different layouts, and put
    side by side again by row position."""
    from ..operators.zipping import zip_stored
    features, latents = scratch_path(spark, "features"), scratch_path(spark, "latents")
    data = scaled(spark, sf)
    by_pos = [F.col("pos").asc()]
    od.sorted_by_range(data, by_pos, 5).select("pos", "year", "magnitude", "depth").write.parquet(features)
    od.sorted_by_range(encoded(data), by_pos, 3).select(*LATENTS).write.option("maxRecordsPerFile", 700).parquet(latents)
    return zip_stored(spark, features, latents).select("pos", "year", "magnitude", "depth", *_lat())


@register("anomaly_threshold", build(f"""SELECT {R6('threshold')} AS threshold, {R6('mean_error')} AS mean_error,
  {R6('std_error')} AS std_error FROM thr""", "scored"))
def q_anomaly_threshold(spark, sf):
    t = an.anomaly_threshold(scored_fixed(spark, sf))
    return t.select(*[r6(c).alias(c) for c in ("threshold", "mean_error", "std_error")])


@register("classify_anomaly", build(f"SELECT pos, is_anomaly FROM flagged", "scored"))
def q_classify_anomaly(spark, sf):
    s = scored_fixed(spark, sf)
    return an.classify_anomaly(s, an.threshold_value(s)).select("pos", "is_anomaly")


@register("anomaly_report", build(f"""SELECT pos, year, m_raw AS magnitude_raw, {R6('err')} AS reconstruction_error,
  is_anomaly FROM flagged""", "scored"), headline=True)
def q_anomaly_report(spark, sf):
    rep = an.anomaly_report(scored_fixed(spark, sf))
    return rep.select("pos", "year", F.col("magnitude").alias("magnitude_raw"),
                      r6("reconstruction_error").alias("reconstruction_error"), "is_anomaly")


@register("anomaly_counts", build(f"""SELECT CAST(count_if(is_anomaly = 0) AS BIGINT) AS normal,
  CAST(count_if(is_anomaly = 1) AS BIGINT) AS anomalous, CAST(count(*) AS BIGINT) AS total,
  {R6('count_if(is_anomaly = 1) / count(*) * 100.0')} AS anomalous_pct FROM flagged""", "scored"))
def q_anomaly_counts(spark, sf):
    s = scored_fixed(spark, sf)
    c = an.anomaly_counts(an.anomaly_report(s))
    return c.select("normal", "anomalous", "total", r6("anomalous_pct").alias("anomalous_pct"))


@register("top_anomalies", build(f"""SELECT pos, {R6('err')} AS reconstruction_error FROM scored
ORDER BY err DESC, pos LIMIT 10""", "scored"))
def q_top_anomalies(spark, sf):
    s = scored_fixed(spark, sf)
    t = tk.top_k(s, "reconstruction_error", 10, tie=("pos",))
    return t.select("pos", r6("reconstruction_error").alias("reconstruction_error"))


@register("split_by_flag", build("SELECT pos, year FROM flagged WHERE is_anomaly = 1", "scored"))
def q_split_by_flag(spark, sf):
    from ..operators.filters import split_by_flag
    s = scored_fixed(spark, sf)
    return split_by_flag(an.anomaly_report(s), "is_anomaly", 1).select("pos", "year")


cte("records", f"""rec_in AS (SELECT c.event_id, (c.magnitude - s.mu0) / s.sd0 AS magnitude,
  (c.depth - s.mu1) / s.sd1 AS depth, (c.latitude - s.mu2) / s.sd2 AS latitude,
  (c.longitude - s.mu3) / s.sd3 AS longitude
  FROM cat c, fstats s WHERE c.magnitude IS NOT NULL AND c.depth IS NOT NULL
    AND c.latitude IS NOT NULL AND c.longitude IS NOT NULL),
{_net_sql("rec_in", CHECK_PARAMS, F4, "rq")},
rec_scored AS (SELECT event_id, ({_err_terms.replace('rn_', 'rq_')}) / 4.0 AS err FROM rq)""", ("scored",))


@register("score_records", build(f"""SELECT r.event_id, {R6('r.err')} AS reconstruction_error,
  CAST(r.err > t.threshold AS INTEGER) AS is_anomaly FROM rec_scored r, thr t""", "records"))
def q_score_records(spark, sf):
    from ..streaming.score import score_records
    from .q_core import cat
    d = dedup(spark, sf)
    stats = sc.fit_standard(d)
    thr = an.threshold_value(net.score_arrow(sc.standard_scale(d, stats, "z_"), CHECK_PARAMS, ZF))
    return score_records(cat(spark, sf), stats, CHECK_PARAMS, thr).select(
        "event_id", r6("reconstruction_error").alias("reconstruction_error"), "is_anomaly")


# ---------------------------------------------------------------------------
# 2.9 grouped K-Means (deterministic init, to convergence) and quality
# ---------------------------------------------------------------------------
@register("kmeans_by_year", build(f"""SELECT c.year, l.cluster_label, l.n, {R6('v[1]')} AS c0, {R6('v[2]')} AS c1,
  {R6('v[3]')} AS c2, {R6('v[4]')} AS c3
FROM c_rank c JOIN (SELECT year, lab AS cluster_label, CAST(count(*) AS BIGINT) AS n FROM km_lab GROUP BY 1, 2) l
  ON c.year = l.year AND c.canon = l.cluster_label""", "kmeans"), headline=True)
def q_kmeans_by_year(spark, sf):
    lab, res = kmeans_fixed(spark, sf)
    return res.centres_frame(lab).select("year", "cluster_label", "n", *[r6(f"c{i}").alias(f"c{i}") for i in range(4)])


_LAT5_SQL = ", ".join(f"{R6(f'e.en_{j}')} AS latent_feature_{j}" for j in range(5))


@register("cluster_result_table", build(f"""SELECT k.pos, k.year, k.lab AS cluster_label, f.magnitude, f.depth,
  f.latitude, f.longitude, {_LAT5_SQL} FROM km_lab k JOIN feat f ON k.pos = f.pos JOIN en e ON k.pos = e.pos""",
    "kmeans", "encnet"))
def q_cluster_result_table(spark, sf):
    lab, _ = kmeans_fixed(spark, sf)
    return encoded(lab).select("pos", "year", "cluster_label", *F4, *_lat(5))


@register("union_years", build("""SELECT k.pos, k.year, k.lab AS cluster_label,
  CASE WHEN k.year <= 2016 THEN f.magnitude END AS magnitude FROM km_lab k JOIN feat f ON k.pos = f.pos""", "kmeans"))
def q_union_years(spark, sf):
    """Two saved exports, one folder a year, the later one without magnitude."""
    lab, _ = kmeans_fixed(spark, sf)
    early, late = scratch_path(spark, "years-early"), scratch_path(spark, "years-late")
    io.write_partitioned(lab.where("year <= 2016").select("pos", "year", "cluster_label", "magnitude"), early, "year", "parquet")
    io.write_partitioned(lab.where("year > 2016").select("year", "cluster_label", "pos"), late, "year", "parquet")
    return io.union_years(spark, [early, late]).select("pos", "year", "cluster_label", "magnitude")


@register("write_partitioned", build("SELECT pos, lab AS cluster_label, year FROM km_lab WHERE year = 2015", "kmeans"))
def q_write_partitioned(spark, sf):
    """One year of the saved per-year export; the other folders are not read."""
    lab, _ = kmeans_fixed(spark, sf)
    path = io.write_partitioned(lab.select("pos", "year", "cluster_label"), scratch_path(spark, "years"), "year", "csv")
    return (spark.read.schema("pos long, cluster_label int, year int").option("header", True).csv(path)
            .where(F.col("year") == 2015))


@register("filter_cluster", build("SELECT pos, year FROM km_lab WHERE lab = 0", "kmeans"))
def q_filter_cluster(spark, sf):
    from ..operators.filters import filter_cluster
    lab, _ = kmeans_fixed(spark, sf)
    return filter_cluster(lab, 0).select("pos", "year")


@register("cluster_stats", build(f"""SELECT k.year, k.lab AS cluster_label, CAST(count(*) AS BIGINT) AS rows,
  {R6('avg(f.magnitude)')} AS mean_magnitude, {R6('avg(f.depth)')} AS mean_depth
FROM km_lab k JOIN feat f ON k.pos = f.pos GROUP BY 1, 2""", "kmeans"))
def q_cluster_stats(spark, sf):
    lab, _ = kmeans_fixed(spark, sf)
    return km.cluster_stats(lab).select("year", "cluster_label", "rows", r6("mean_magnitude").alias("mean_magnitude"),
                                        r6("mean_depth").alias("mean_depth"))


@register("dominant_cluster", build(f"""SELECT year, dominant_label, n AS count, total,
  {R6('n / total * 100.0')} AS pct FROM (
  SELECT year, lab AS dominant_label, n, sum(n) OVER (PARTITION BY year) AS total,
    row_number() OVER (PARTITION BY year ORDER BY n DESC, lab) AS rk
  FROM (SELECT year, lab, CAST(count(*) AS BIGINT) AS n FROM km_lab GROUP BY 1, 2)) WHERE rk = 1""",
    "kmeans").replace("sum(n) OVER (PARTITION BY year) AS total", "CAST(sum(n) OVER (PARTITION BY year) AS BIGINT) AS total"))
def q_dominant_cluster(spark, sf):
    lab, _ = kmeans_fixed(spark, sf)
    d = km.dominant_cluster(lab)
    return d.select("year", F.col("dominant_label").cast("int").alias("dominant_label"), "count", "total",
                    r6("pct").alias("pct"))


cte("pairsum", """pairsum AS (
  SELECT a.year, a.pos, a.lab AS own, b.lab AS label,
    sum(sqrt((a.magnitude - b.magnitude) * (a.magnitude - b.magnitude) + (a.depth - b.depth) * (a.depth - b.depth)
      + (a.latitude - b.latitude) * (a.latitude - b.latitude) + (a.longitude - b.longitude) * (a.longitude - b.longitude))) AS sum_d,
    CAST(count(*) AS BIGINT) AS cnt
  FROM km_lab a JOIN km_lab b ON a.year = b.year GROUP BY 1, 2, 3, 4),
srow AS (
  SELECT year, pos, CASE WHEN max(cnt) FILTER (WHERE own = label) <= 1 THEN 0.0
      WHEN min(sum_d / cnt) FILTER (WHERE own <> label) IS NULL THEN NULL
      ELSE (min(sum_d / cnt) FILTER (WHERE own <> label) - sum(sum_d) FILTER (WHERE own = label) / CAST(max(cnt) FILTER (WHERE own = label) - 1 AS DOUBLE))
        / greatest(sum(sum_d) FILTER (WHERE own = label) / CAST(max(cnt) FILTER (WHERE own = label) - 1 AS DOUBLE),
                   min(sum_d / cnt) FILTER (WHERE own <> label)) END AS s
  FROM pairsum GROUP BY 1, 2),
sil AS (
  SELECT k.year, CASE WHEN count(DISTINCT k.lab) < 2 OR count(DISTINCT k.lab) = count(*) THEN NULL
    ELSE avg(s.s) END AS silhouette
  FROM km_lab k LEFT JOIN srow s ON k.year = s.year AND k.pos = s.pos GROUP BY k.year)""", ("kmeans",))


def _sil(spark, sf):
    lab, _ = kmeans_fixed(spark, sf)
    return sil.silhouette_by_year(lab, ZF)


@register("silhouette_by_year", build(f"SELECT year, {R6('silhouette')} AS silhouette FROM sil", "pairsum"),
          headline=True)
def q_silhouette_by_year(spark, sf):
    return _sil(spark, sf).select("year", r6("silhouette").alias("silhouette"))


@register("all_pairs_by_year", build(f"""SELECT year, pos, label, {R6('sum_d / cnt')} AS mean_distance, cnt
FROM pairsum""", "pairsum"))
def q_all_pairs_by_year(spark, sf):
    """Per row and label: mean distance to that label's rows of the same year
    (the pairwise step of the silhouette), computed block-wise."""
    lab, _ = kmeans_fixed(spark, sf)
    return sil.mean_distance_to_labels(lab, ZF).select(
        "year", "pos", "label", r6(F.col("sum_d") / F.col("cnt")).alias("mean_distance"), "cnt")


@register("silhouette_summary", build(f"""SELECT {R6('avg(silhouette)')} AS mean, {R6('max(silhouette)')} AS max,
  {R6('min(silhouette)')} AS min, CAST(count(*) AS BIGINT) AS years FROM sil WHERE silhouette IS NOT NULL""",
    "pairsum"))
def q_silhouette_summary(spark, sf):
    s = sil.silhouette_summary(_sil(spark, sf))
    return s.select(r6("mean").alias("mean"), r6("max").alias("max"), r6("min").alias("min"), "years")


cte("silfast", """cl AS (SELECT year, lab, CAST(count(*) AS DOUBLE) AS n,
    sum(magnitude * magnitude + depth * depth + latitude * latitude + longitude * longitude) AS q,
    sum(magnitude) AS s0, sum(depth) AS s1, sum(latitude) AS s2, sum(longitude) AS s3
  FROM km_lab GROUP BY 1, 2),
fr AS (SELECT k.year, k.pos, k.lab AS own, c.lab, c.n,
    (c.n * (k.magnitude * k.magnitude + k.depth * k.depth + k.latitude * k.latitude + k.longitude * k.longitude)
     - 2.0 * (k.magnitude * c.s0 + k.depth * c.s1 + k.latitude * c.s2 + k.longitude * c.s3) + c.q) AS tot
  FROM km_lab k JOIN cl c ON k.year = c.year),
fs AS (SELECT year, pos, max(n) FILTER (WHERE own = lab) AS own_n,
    max(tot) FILTER (WHERE own = lab) / (max(n) FILTER (WHERE own = lab) - 1) AS a,
    min(tot / n) FILTER (WHERE own <> lab) AS b, min(own) AS own
  FROM fr GROUP BY 1, 2),
silf AS (SELECT year, CASE WHEN count(DISTINCT own) < 2 OR count(DISTINCT own) = count(*) THEN NULL
    ELSE avg(CASE WHEN own_n <= 1 THEN 0.0 WHEN b IS NULL THEN NULL ELSE (b - a) / greatest(a, b) END) END AS silhouette
  FROM fs GROUP BY year)""", ("kmeans",))


@register("silhouette_by_year_fast", build(f"SELECT year, {R6('silhouette')} AS silhouette FROM silf", "silfast"))
def q_silhouette_fast(spark, sf):
    lab, _ = kmeans_fixed(spark, sf)
    return sil.silhouette_by_year_fast(lab, ZF).select("year", r6("silhouette").alias("silhouette"))


# ---------------------------------------------------------------------------
# K-Means on the latent layer
# ---------------------------------------------------------------------------
cte("kmlat", _km_sql("en", tuple(f"en_{j}" for j in range(N_LATENT)), "l_"), ("encnet",))


@register("kmeans_latents", build("SELECT pos, year, lab AS cluster_label FROM l_km_lab", "kmlat"))
def q_kmeans_latents(spark, sf):
    lab, _ = km.kmeans_by_year(encoded(scaled(spark, sf)), LATENTS, k=2)
    return lab.select("pos", "year", "cluster_label")


# ---------------------------------------------------------------------------
# MLlib PCA: the linear autoencoder.
# Eigenvectors have no SQL twin, but what they must satisfy has.
# ---------------------------------------------------------------------------
@register("pca_reconstruct_error", build(f"""SELECT CAST(count(*) AS BIGINT) AS n,
  {R6('var_samp(magnitude) + var_samp(depth) + var_samp(latitude) + var_samp(longitude)')} AS total_variance,
  0.0 AS eigen_residual, 0.0 AS error_residual FROM fscaled""", "feat"))
def q_pca_reconstruct_error(spark, sf):
    """Residuals of ``C v = lambda v`` and of "mean error = dropped
    eigenvalues x (n - 1) / n / 4", which are zero for a right fit."""
    from ..operators import pca
    s = scaled(spark, sf)
    fit = pca.fit_pca(s, ZF, k=2)
    return pca.identities(pca.pca_reconstruct_error(s, ZF, fit=fit), ZF, fit).select(
        "n", r6("total_variance").alias("total_variance"), r6("eigen_residual").alias("eigen_residual"),
        r6("error_residual").alias("error_residual"))


_SPLIT_SQL = f"""SELECT k.k AS components, (SELECT count(*) FROM feat WHERE pos < c.cut) AS n_train,
  (SELECT count(*) FROM feat WHERE pos >= c.cut) AS n_validation, 0.0 AS error_residual
FROM (SELECT CAST(floor(count(*) * {1 - AE_VALIDATION!r}) AS BIGINT) AS cut FROM feat) c, (VALUES %s) k(k)"""


def _linear_autoencoders(spark, sf, ks):
    """Fitted on the leading rows, scored on all: per number of components
    the rows on both sides and the training identity's residual."""
    from ..operators import pca
    s = od.validation_tail(scaled(spark, sf), AE_VALIDATION)
    train, tail = s.where("is_validation = 0"), s.where("is_validation = 1")
    out = []
    for k, fit in zip(ks, pca.fit_pcas(train, ZF, ks, centred=False)):
        one = pca.identities(pca.pca_reconstruct_error(train, ZF, fit=fit), ZF, fit)
        out.append(one.select(F.lit(k).alias("components"), F.col("n").alias("n_train"),
                              tail.agg(F.count(F.lit(1))).scalar().alias("n_validation"),
                              r6("error_residual").alias("error_residual")))
    return out


@register("fit_autoencoder", build(_SPLIT_SQL % "(2)", "feat"))
def q_fit_autoencoder(spark, sf):
    return _linear_autoencoders(spark, sf, (2,))[0]


@register("linear_autoencoders", build(_SPLIT_SQL % "(1), (2), (3), (4)", "feat"))
def q_linear_autoencoders(spark, sf):
    a, b, c, d = _linear_autoencoders(spark, sf, (1, 2, 3, 4))
    return a.union(b).union(c).union(d)


# ---------------------------------------------------------------------------
# The full autoencoder, trained: its losses have no SQL twin
# ---------------------------------------------------------------------------
@register("loss_history")
def q_loss_history(spark, sf):
    """Training and validation loss of every epoch of the 4-64-32-10-32-64-4
    network, trained on the leading rows and measured on the tail."""
    from ..operators import train
    s = od.validation_tail(scaled(spark, sf), AE_VALIDATION, gaps=True)
    return train.loss_history(spark, train.fit_autoencoder(s, ZF))


# ---------------------------------------------------------------------------
# 2-D density of each (year, cluster)
# ---------------------------------------------------------------------------
KDE2_GRID = 50
cte("kde2", f"""k2pts AS (SELECT k.year, k.lab AS cluster_label, f.longitude AS px, f.latitude AS py
  FROM km_lab k JOIN feat f ON k.pos = f.pos),
k2st0 AS (SELECT year, cluster_label, count(*) AS n, var_samp(px) AS vx, var_samp(py) AS vy,
    covar_samp(px, py) AS cxy, min(px) AS x_lo, max(px) AS x_hi, min(py) AS y_lo, max(py) AS y_hi
  FROM k2pts GROUP BY 1, 2 HAVING count(*) >= 2),
k2st1 AS (SELECT *, vx * pow(CAST(n AS DOUBLE), -0.3333333333333333) AS hxx,
    vy * pow(CAST(n AS DOUBLE), -0.3333333333333333) AS hyy,
    cxy * pow(CAST(n AS DOUBLE), -0.3333333333333333) AS hxy FROM k2st0),
k2st2 AS (SELECT *, hxx * hyy - hxy * hxy AS det, x_lo - 3.0 * sqrt(hxx) AS gx0, y_lo - 3.0 * sqrt(hyy) AS gy0
  FROM k2st1),
k2st AS (SELECT *, ((x_hi + 3.0 * sqrt(hxx)) - gx0) / {float(KDE2_GRID - 1)} AS sx,
    ((y_hi + 3.0 * sqrt(hyy)) - gy0) / {float(KDE2_GRID - 1)} AS sy FROM k2st2 WHERE det > 0),
k2grid AS (SELECT s.*, CAST(i.range AS INTEGER) AS gi, CAST(j.range AS INTEGER) AS gj
  FROM k2st s, range({KDE2_GRID}) i, range({KDE2_GRID}) j),
k2 AS (SELECT g.year, g.cluster_label, g.gi, g.gj, g.gx0 + g.gi * g.sx AS x, g.gy0 + g.gj * g.sy AS y,
    sum(exp(-0.5 * ((((g.gx0 + g.gi * g.sx) - p.px) * ((g.gx0 + g.gi * g.sx) - p.px) * g.hyy
      - 2.0 * ((g.gx0 + g.gi * g.sx) - p.px) * ((g.gy0 + g.gj * g.sy) - p.py) * g.hxy
      + ((g.gy0 + g.gj * g.sy) - p.py) * ((g.gy0 + g.gj * g.sy) - p.py) * g.hxx) / g.det)))
      / (CAST(g.n AS DOUBLE) * 6.283185307179586 * sqrt(g.det)) AS density
  FROM k2grid g JOIN k2pts p ON g.year = p.year AND g.cluster_label = p.cluster_label
  GROUP BY g.year, g.cluster_label, g.gi, g.gj, g.gx0, g.gy0, g.sx, g.sy, g.n, g.det)""", ("kmeans",))


@register("kde_2d_by_cluster", build(f"""SELECT year, cluster_label, gi, gj, {R6('x')} AS x, {R6('y')} AS y,
  {R6('density')} AS density FROM k2""", "kde2"))
def q_kde_2d_by_cluster(spark, sf):
    from ..operators.explore import kde_2d_by_group
    lab, _ = kmeans_fixed(spark, sf)
    k = kde_2d_by_group(lab, gridsize=KDE2_GRID)
    return k.select("year", "cluster_label", "gi", "gj", r6("x").alias("x"), r6("y").alias("y"),
                    r6("density").alias("density"))


@register("model_broadcast_join", build(f"""SELECT pos, year, {R6('magnitude')} AS magnitude, {R6('depth')} AS depth,
  {R6('latitude')} AS latitude, {R6('longitude')} AS longitude FROM fscaled""", "feat"))
def q_model_broadcast_join(spark, sf):
    """Every row sees the fitted scaler through scalar subqueries."""
    s = sc.standard_scale_lazy(dedup(spark, sf), F4)
    return s.select("pos", "year", *[r6(c).alias(c) for c in F4])


@register("model_broadcast_join_by_year", build(f"""SELECT f.pos, f.year, {", ".join(
    R6(f"(f.{c} - m.m_{c}) / m.s_{c}") + f" AS {c}" for c in F4)}
FROM feat f LEFT JOIN (SELECT year, {", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in F4)}
  FROM feat GROUP BY year) m ON f.year IS NOT DISTINCT FROM m.year""", "feat"))
def q_model_broadcast_join_by_year(spark, sf):
    """Every row meets the scaler of its year."""
    d = dedup(spark, sf)
    models = cut_lineage(sc.standard_stats_by(d, "year", F4), "models")
    return sc.scale_by_model(d, models, "year", F4).select("pos", "year", *[r6(c).alias(c) for c in F4])
