"""Linear reconstruction error with MLlib PCA (for users without a trained
network): project standardised features on the top-k components and back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anomaly import ERR


@dataclass(frozen=True)
class PcaFit:
    """All components (d x d, by falling variance), how many are kept, their
    shares of the variance, and the means that are taken off first."""
    components: list[list[float]]
    k: int
    shares: list[float]
    mean: list[float]


def fit_pca(df: DataFrame, cols: Sequence[str], k: int = 2, centred: bool = True) -> PcaFit:
    """MLlib PCA (distributed covariance). ``centred`` tells that the columns
    have mean 0 already; else their means are fitted too."""
    return fit_pcas(df, cols, (k,), centred)[0]


def fit_pcas(df: DataFrame, cols: Sequence[str], ks: Sequence[int], centred: bool = True) -> list[PcaFit]:
    """``fit_pca`` for every number of components: the rows are read for one
    fit, as all components are found at once."""
    cols = list(cols)
    rows = df.dropna(subset=cols)
    mean = [0.0] * len(cols) if centred else [float(m) for m in rows.agg(*[F.avg(c) for c in cols]).first()]
    va = VectorAssembler(inputCols=cols, outputCol="_v")
    model = PCA(k=len(cols), inputCol="_v", outputCol="_p").fit(va.transform(rows.select(*cols)))
    return [PcaFit(model.pc.toArray().tolist(), k, [float(x) for x in model.explainedVariance], mean) for k in ks]


def pca_reconstruct_error(df: DataFrame, cols: Sequence[str], k: int = 2, fit: PcaFit | None = None) -> DataFrame:
    """``reconstruction_error`` = mean squared difference between the row and
    its back-projection ``P P^T x`` (column expressions, no Python)."""
    cols = list(cols)
    fit = fit or fit_pca(df, cols, k)
    pc = fit.components
    x = [F.col(c) - F.lit(m) for c, m in zip(cols, fit.mean)]
    proj = [reduce(lambda a, b: a + b, [x[i] * F.lit(pc[i][j]) for i in range(len(cols))]) for j in range(fit.k)]
    tmp = df.withColumns({f"_p{j}": p for j, p in enumerate(proj)})
    back = [reduce(lambda a, b: a + b, [F.col(f"_p{j}") * F.lit(pc[i][j]) for j in range(fit.k)])
            for i in range(len(cols))]
    sq = [(v - b) * (v - b) for v, b in zip(x, back)]
    err = reduce(lambda a, b: a + b, sq) / F.lit(float(len(cols)))
    return tmp.withColumn(ERR, err).drop(*[f"_p{j}" for j in range(fit.k)])


def identities(scored: DataFrame, cols: Sequence[str], fit: PcaFit) -> DataFrame:
    """1 row about the rows a fit was made on: ``n``, ``total_variance``
    (sample), ``eigen_residual`` (largest entry of ``C v - lambda v`` over the
    components) and ``error_residual`` (mean error minus the dropped
    variances times (n - 1) / n over the width); both residuals are 0 for a
    right fit."""
    cols = list(cols)
    d = len(cols)
    cov = {(i, j): F.covar_samp(cols[i], cols[j]) for i in range(d) for j in range(d)}
    total = reduce(lambda a, b: a + b, [cov[i, i] for i in range(d)])
    gaps = []
    for j in range(d):
        v = [fit.components[i][j] for i in range(d)]
        for i in range(d):
            cv = reduce(lambda a, b: a + b, [cov[i, m] * F.lit(v[m]) for m in range(d)])
            gaps.append(F.abs(cv - total * F.lit(fit.shares[j] * v[i])))
    n = F.count(F.lit(1))
    dropped = sum(fit.shares[fit.k:])
    return scored.agg(n.alias("n"), total.alias("total_variance"), F.greatest(*gaps).alias("eigen_residual"),
                      F.abs(F.avg(ERR) - total * F.lit(dropped) * (n - 1) / n / F.lit(float(d))).alias("error_residual"))
