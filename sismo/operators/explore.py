"""Exploratory aggregates: KPIs, yearly/monthly means, per-year magnitude
statistics, histograms, kernel densities, correlation and least squares.

All are hash aggregations with map-side partial aggregation; scalar inputs
(min, max, n, std) enter as scalar subqueries, never through joins with a
one-row frame or unpartitioned windows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import HIST_BINS, HIST_STEP, KDE_CUT, KDE_GRID
from .quantiles import exact_quantiles

REACH = 7.5  # bandwidths beyond which a Gaussian kernel is under 1e-12
GRIDS = 200  # grids that a task holds


def kpi_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min("year").alias("min_year"),
                  F.max("year").alias("max_year"), F.avg("magnitude").alias("mean_magnitude"),
                  F.avg("depth").alias("mean_depth"))


def yearly_mean_magnitude(df: DataFrame) -> DataFrame:
    return (df.where(F.col("year").isNotNull()).groupBy("year")
            .agg(F.avg("magnitude").alias("mean_magnitude")))


def monthly_mean_magnitude(df: DataFrame) -> DataFrame:
    """Mean magnitude per calendar month (rows with null datetime or
    magnitude dropped)."""
    d = df.where(F.col("datetime").isNotNull() & F.col("magnitude").isNotNull())
    return (d.groupBy(F.year("datetime").cast("int").alias("year"),
                      F.month("datetime").cast("int").alias("month"))
            .agg(F.avg("magnitude").alias("mean_magnitude")))


def yearly_counts(df: DataFrame, first: int, last: int) -> DataFrame:
    return (df.where(F.col("year").between(first, last)).groupBy("year")
            .agg(F.count(F.lit(1)).alias("frequency")))


def year_magnitude_stats(df: DataFrame) -> DataFrame:
    """count, min, max, mean and exact median of magnitude for every year in
    one job (no per-year driver loop)."""
    d = df.where(F.col("year").isNotNull())
    mom = d.groupBy("year").agg(F.count("magnitude").alias("count"), F.min("magnitude").alias("min"),
                                F.max("magnitude").alias("max"), F.avg("magnitude").alias("mean"))
    # one target row per year: few, so broadcast
    med = exact_quantiles(d, "magnitude", (0.5,), by=("year",)).select(
        "year", F.col("q_0_5").alias("median"))
    return mom.join(med, "year", "left")


def skew_label(stats: DataFrame) -> DataFrame:
    """``left`` when mean < median, ``right`` when mean > median, else
    ``symmetric``."""
    return stats.withColumn("skew", F.when(F.col("mean") < F.col("median"), F.lit("left"))
                            .when(F.col("mean") > F.col("median"), F.lit("right"))
                            .otherwise(F.lit("symmetric")))


def histogram_equal_width(df: DataFrame, col: str, bins: int = HIST_BINS) -> DataFrame:
    """``bins`` equal bins from min to max (last bin closed), every bin
    present (empty ones with 0). Columns: bin, lo, hi, count, density."""
    vals = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull()
                                                                 & ~F.isnan("x"))
    st = vals.agg(F.min("x").alias("mn"), F.max("x").alias("mx"), F.count(F.lit(1)).alias("n"))
    mn0, mx0, n = st.select("mn").scalar(), st.select("mx").scalar(), st.select("n").scalar()
    # degenerate range -> [v - 0.5, v + 0.5]
    mn = F.when(mn0 == mx0, mn0 - F.lit(0.5)).otherwise(mn0)
    mx = F.when(mn0 == mx0, mx0 + F.lit(0.5)).otherwise(mx0)
    width = (mx - mn) / F.lit(float(bins))
    idx = F.least(F.lit(bins - 1),
                  F.floor((F.col("x") - mn) * F.lit(float(bins)) / (mx - mn)).cast("int"))
    counts = vals.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = spine.join(F.broadcast(counts), "bin", "left").select(
        "bin", (mn + F.col("bin") * width).alias("lo"), (mn + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"))
    return out.withColumn("density", F.col("count") / (n.cast("double") * width))


def histogram_step(df: DataFrame, col: str, step: float = HIST_STEP) -> DataFrame:
    """Fixed-step bins anchored at 0: ``bin = floor(x / step)``; ``lo = bin *
    step``. The 1e-9 guard keeps values on an edge (2.6 / 0.2) in their bin."""
    inv = 1.0 / step
    vals = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    b = F.floor(F.col("x") * F.lit(inv) + F.lit(1e-9)).cast("long")
    return (vals.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
            .withColumn("lo", F.col("bin") * F.lit(float(step))))


def kde_1d(df: DataFrame, col: str, gridsize: int = KDE_GRID, cut: float = KDE_CUT) -> DataFrame:
    """Gaussian kernel density on ``gridsize`` points from ``min - cut*bw``
    to ``max + cut*bw``; Scott bandwidth ``bw = std_samp * n^(-1/5)``.

    Values are pre-aggregated to (value, multiplicity); each distinct value
    generates its grid contributions inside its task and a partial
    aggregation on the grid index collapses them before the shuffle, so the
    shuffle carries at most ``gridsize`` rows per partition. Kernels end
    ``REACH`` bandwidths away, where they are under 1e-12."""
    vals = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull()
                                                                 & ~F.isnan("x"))
    st = vals.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"),
                  F.min("x").alias("mn"), F.max("x").alias("mx"))
    n = st.select("n").scalar().cast("double")
    bw = st.select(F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).scalar()
    lo = st.select("mn").scalar() - F.lit(cut) * bw
    hi = st.select("mx").scalar() + F.lit(cut) * bw
    step = (hi - lo) / F.lit(float(gridsize - 1))
    weighted = vals.groupBy("x").agg(F.count(F.lit(1)).alias("w")).withColumns({"_lo": lo, "_step": step, "_bw": bw})

    def sums(batches):
        """One row per grid point and task: the kernel sums of its values."""
        total, g = None, np.arange(gridsize)
        for batch in batches:
            x, w, low, st, h = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(5))
            if len(x) == 0 or not h[0] > 0:  # constant input: no density
                continue
            total = np.zeros(gridsize) if total is None else total
            at = low[0] + g * st[0]
            order = np.argsort(x)
            x, w = x[order], w[order]
            for i in range(0, len(x), 512):
                part = x[i:i + 512]  # neighbours, which only the grid points around them feel
                a, b = np.searchsorted(at, (part[0] - REACH * h[0], part[-1] + REACH * h[0]))
                z = (at[a:b, None] - part[None]) / h[0]
                total[a:b] += np.exp(-0.5 * z * z) @ w[i:i + 512]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(total)], names=["g", "k"])

    contrib = weighted.select("x", "w", "_lo", "_step", "_bw").mapInArrow(sums, "g int, k double")
    grid = vals.sparkSession.range(gridsize).select(F.col("id").cast("int").alias("g"))
    gx = lo + F.col("g") * step
    norm = n * bw * F.lit(math.sqrt(2.0 * math.pi))
    dens = contrib.groupBy("g").agg(F.sum("k").alias("s"))
    return (grid.where(n > 0).join(dens, "g", "left")
            .select("g", gx.alias("x"), F.try_divide(F.col("s"), norm).alias("density")))


def correlation(df: DataFrame, x: str = "depth", y: str = "magnitude") -> DataFrame:
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return d.agg(F.corr(x, y).alias("pearson_r"), F.count(F.lit(1)).alias("n"))


def ols_trend(df: DataFrame, x: str = "depth", y: str = "magnitude") -> DataFrame:
    """Least-squares line ``y = intercept + slope * x`` and R²."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return d.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                 F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def kde_2d_by_group(df: DataFrame, x: str = "longitude", y: str = "latitude",
                    by=("year", "cluster_label"), gridsize: int = 50, cut: float = KDE_CUT) -> DataFrame:
    """2-D Gaussian kernel density per group on a ``gridsize`` x ``gridsize``
    grid: kernel covariance = sample covariance x n^(-1/3) (Scott, d = 2);
    each axis spans ``[min - cut*bw, max + cut*bw]``.

    Repeated points are counted first; each task then adds up its points'
    kernels on its groups' grids (``GRIDS`` of them at a time) and emits one row
    per group and grid cell, which a final aggregation sums.
    Kernels end ``REACH`` bandwidths away, where they are under 1e-12: points
    are taken in cells of that size and meet only the grid around them, so work
    is distinct points x grid points within reach. Nothing is exploded."""
    by = list(by)
    pts = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
        .where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    fac = F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3.0))
    st = (pts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.var_samp("_x").alias("vx"),
                               F.var_samp("_y").alias("vy"), F.covar_samp("_x", "_y").alias("cxy"),
                               F.min("_x").alias("x_lo"), F.max("_x").alias("x_hi"),
                               F.min("_y").alias("y_lo"), F.max("_y").alias("y_hi"))
          .where(F.col("n") >= 2)
          .withColumns({"hxx": F.col("vx") * fac, "hyy": F.col("vy") * fac, "hxy": F.col("cxy") * fac}))
    st = st.withColumn("det", F.col("hxx") * F.col("hyy") - F.col("hxy") * F.col("hxy")).where(F.col("det") > 0)
    st = st.withColumns({
        "gx0": F.col("x_lo") - F.lit(cut) * F.sqrt("hxx"),
        "gy0": F.col("y_lo") - F.lit(cut) * F.sqrt("hyy")})
    st = st.withColumns({
        "sx": ((F.col("x_hi") + F.lit(cut) * F.sqrt("hxx")) - F.col("gx0")) / F.lit(float(gridsize - 1)),
        "sy": ((F.col("y_hi") + F.lit(cut) * F.sqrt("hyy")) - F.col("gy0")) / F.lit(float(gridsize - 1))})
    st = st.select(*by, "n", "hxx", "hyy", "hxy", "det", "gx0", "gy0", "sx", "sy")
    weighted = pts.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_w"))
    types = {f.name: f for f in pts.schema.fields}
    out_schema = T.StructType([*[types[b] for b in by], T.StructField("gi", T.IntegerType()), T.StructField("gj", T.IntegerType()),
                               T.StructField("k", T.DoubleType())])
    g = np.arange(gridsize)

    def add(total: np.ndarray, p) -> None:
        """Kernels of one group's points, added to its grid."""
        r = p.iloc[0]
        rx, ry = REACH * np.sqrt(r["hxx"]), REACH * np.sqrt(r["hyy"])
        gx, gy = r["gx0"] + g * r["sx"], r["gy0"] + g * r["sy"]
        px, py, pw = (p[c].to_numpy(dtype=float) for c in ("_x", "_y", "_w"))
        order = np.lexsort((py, px // rx))  # by columns of cells, then upwards
        for i in range(0, len(order), 128):
            x, y, w = (v[order[i:i + 128]] for v in (px, py, pw))
            a, b = np.searchsorted(gx, (x.min() - rx, x.max() + rx))
            c, d = np.searchsorted(gy, (y.min() - ry, y.max() + ry))
            dx, dy = gx[None, a:b, None] - x[:, None, None], gy[None, None, c:d] - y[:, None, None]
            q = (dx * dx * r["hyy"] - 2.0 * dx * dy * r["hxy"] + dy * dy * r["hxx"]) / r["det"]
            total[a:b, c:d] += np.tensordot(w, np.exp(-0.5 * q), axes=1)

    def rows(grids: dict, fields) -> pa.RecordBatch:
        size, n = gridsize ** 2, len(grids)
        keys = [pa.array([k[i] for k in grids for _ in range(size)], f) for i, f in enumerate(fields)]
        at = [np.tile(np.repeat(g, gridsize), n), np.tile(g, gridsize * n)]
        return pa.RecordBatch.from_arrays([*keys, *(pa.array(x, pa.int32()) for x in at), pa.array(np.concatenate([t.ravel() for t in grids.values()]))],
                                          names=[*by, "gi", "gj", "k"])

    def sums(batches):
        grids: dict[tuple, np.ndarray] = {}
        fields = []
        for batch in batches:
            fields = [batch.schema.field(b).type for b in by]
            for key, p in batch.to_pandas().groupby(by, dropna=False, sort=False):
                add(grids.setdefault(key, np.zeros((gridsize, gridsize))), p)
            if len(grids) > GRIDS:
                yield rows(grids, fields)
                grids = {}
        if grids:
            yield rows(grids, fields)

    dens = (weighted.join(st, by).mapInArrow(sums, out_schema)
            .groupBy(*by, "gi", "gj").agg(F.sum("k").alias("s")))
    out = dens.join(st, by)
    norm = F.col("n").cast("double") * F.lit(2.0 * math.pi) * F.sqrt("det")
    return out.select(*by, "gi", "gj",
                      (F.col("gx0") + F.col("gi") * F.col("sx")).alias("x"),
                      (F.col("gy0") + F.col("gj") * F.col("sy")).alias("y"),
                      (F.col("s") / norm).alias("density"))
