"""Reconstruction-error anomaly detection.

The threshold is ``mean + n_sigma * population std`` of the errors — a
scalar subquery over the scored frame, inlined into the flag expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import N_SIGMA

ERR = "reconstruction_error"


def anomaly_threshold(scored: DataFrame, n_sigma: float = N_SIGMA, err: str = ERR) -> DataFrame:
    """1 row: ``threshold, mean_error, std_error``."""
    return scored.agg(F.avg(err).alias("mean_error"), F.stddev_pop(err).alias("std_error")).select(
        (F.col("mean_error") + F.lit(float(n_sigma)) * F.col("std_error")).alias("threshold"),
        "mean_error", "std_error")


def threshold_value(scored: DataFrame, n_sigma: float = N_SIGMA, err: str = ERR) -> Column:
    return anomaly_threshold(scored, n_sigma, err).select("threshold").scalar()


def classify_anomaly(scored: DataFrame, threshold: Column | float, err: str = ERR) -> DataFrame:
    """``is_anomaly = 1`` when the error is strictly above the threshold."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return scored.withColumn("is_anomaly", (F.col(err) > thr).cast("int"))


def anomaly_report(scored: DataFrame, n_sigma: float = N_SIGMA, err: str = ERR) -> DataFrame:
    """Features + error + flag, threshold fitted on the same rows."""
    return classify_anomaly(scored, threshold_value(scored, n_sigma, err), err)


def anomaly_counts(flagged: DataFrame) -> DataFrame:
    """normal, anomalous, total and anomalous percentage."""
    agg = flagged.agg(F.count_if(F.col("is_anomaly") == 0).alias("normal"),
                      F.count_if(F.col("is_anomaly") == 1).alias("anomalous"),
                      F.count(F.lit(1)).alias("total"))
    pct = F.when(F.col("total") > 0, F.col("anomalous") / F.col("total") * F.lit(100.0))
    return agg.withColumn("anomalous_pct", pct)
