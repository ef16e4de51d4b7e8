"""Next-year cell forecasts from the last ``L`` scaled yearly counts.

A forecaster maps ``x0..x{L-1}`` (per-series min-max scaled counts) to the
scaled next value. Two kinds:

* ``LinearForecaster`` — fixed or fitted weights, scored as one column
  expression (whole-stage codegen, no Python);
* MLlib models (``LinearRegression``, ``GBTRegressor``,
  ``RandomForestRegressor``) fitted on the sliding windows of all cells,
  distributed by MLlib and scored by ``model.transform``.

Scoring all cells is one projection; the top-k is a ``TakeOrderedAndProject``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import (BIN_SIZE, METHOD_FREQUENCY, METHOD_GBT, METHOD_LINEAR, METHOD_RF, METHOD_WEIGHTED, SEED,
                      SEQUENCE_LENGTH, TARGET_YEAR, TOP_K)
from .series import cell_year_series, last_sequence, minmax_inverse, minmax_scale_series
from .spatial import hotspots_frequency

XS = [f"x{i}" for i in range(SEQUENCE_LENGTH)]


@dataclass(frozen=True)
class LinearForecaster:
    """``pred = ((w0*x0 + w1*x1) + ...) + b`` summed left to right."""
    weights: tuple[float, ...]
    intercept: float = 0.0
    method: str = METHOD_LINEAR

    def expr(self) -> Column:
        terms = [F.col(f"x{i}") * F.lit(float(w)) for i, w in enumerate(self.weights)]
        return reduce(lambda a, b: a + b, terms) + F.lit(float(self.intercept))

    def sql(self) -> str:
        s = " + ".join(f"x{i} * {float(w)!r}" for i, w in enumerate(self.weights))
        return f"(({s}) + {float(self.intercept)!r})"

    def predict(self, df: DataFrame, out: str = "pred_scaled") -> DataFrame:
        return df.withColumn(out, self.expr())


# A fixed weighted moving average: the SQL-checkable forecaster (weights sum to 1).
WEIGHTED_AVERAGE = LinearForecaster((0.1, 0.15, 0.2, 0.25, 0.3), 0.0, METHOD_WEIGHTED)


@dataclass
class MLlibForecaster:
    model: object
    method: str
    features: tuple[str, ...] = tuple(XS)

    def predict(self, df: DataFrame, out: str = "pred_scaled") -> DataFrame:
        va = VectorAssembler(inputCols=list(self.features), outputCol="_features")
        scored = self.model.transform(va.transform(df))
        col = self.model.getOrDefault("predictionCol")
        return scored.withColumnRenamed(col, out).drop("_features")


def fit_sequence_forecaster(sequences: DataFrame, kind: str = "linear", seed: int = SEED,
                            **params) -> MLlibForecaster:
    """Fit one model for all cells on the sliding windows (``x0..x4 -> y``).

    ``linear``: MLlib least squares (normal equations for 5 features, one
    pass of partial aggregates); ``gbt`` / ``rf``: MLlib tree ensembles."""
    va = VectorAssembler(inputCols=XS, outputCol="_features")
    train = va.transform(sequences.where(F.col("y").isNotNull()))
    if kind == "linear":
        est = LinearRegression(featuresCol="_features", labelCol="y", solver="normal",
                               **params)
    elif kind == "gbt":
        est = GBTRegressor(featuresCol="_features", labelCol="y", seed=seed, **params)
    elif kind == "rf":
        est = RandomForestRegressor(featuresCol="_features", labelCol="y", seed=seed, **params)
    else:
        raise ValueError(f"unknown forecaster kind {kind!r}")
    return MLlibForecaster(est.fit(train), {"linear": METHOD_LINEAR, "gbt": METHOD_GBT, "rf": METHOD_RF}[kind])


def linear_from_mllib(f: MLlibForecaster) -> LinearForecaster:
    m = f.model
    return LinearForecaster(tuple(float(c) for c in m.coefficients), float(m.intercept))


def forecaster_metrics(model, sequences: DataFrame) -> DataFrame:
    """MSE and MAE of scaled predictions against scaled targets."""
    p = model.predict(sequences)
    err = F.col("y") - F.col("pred_scaled")
    return p.agg(F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
                 F.count(F.lit(1)).alias("n"))


def hotspots_forecast(series: DataFrame, model, top_k: int = TOP_K,
                      target_year: int = TARGET_YEAR) -> DataFrame:
    """Forecast the next-year count of every cell, keep the top-k.

    ``count = max(0, round_half_even(inverse(pred)))``, a cell without a
    prediction (null or NaN) keeps its last observed count; ties by (lat,
    lon). ``historical_count`` = the series total, ``mag`` = mean magnitude."""
    last = last_sequence(minmax_scale_series(series))
    newest = F.col(f"x{SEQUENCE_LENGTH - 1}")
    pred = F.when(F.isnan("pred_scaled"), newest).otherwise(F.coalesce("pred_scaled", newest))
    scored = model.predict(last).withColumn("pred_scaled", pred)
    count = F.greatest(F.lit(0.0), F.rint(minmax_inverse("pred_scaled"))).cast("long")
    pts = scored.select(F.col("lat_bin").alias("lat"), F.col("lon_bin").alias("lon"),
                        count.alias("count"), F.col("historical_count").cast("long"),
                        F.col("mean_mag").alias("mag"),
                        F.lit(target_year).cast("int").alias("year"),
                        F.lit(None).cast("int").alias("month"))
    return pts.orderBy(F.col("count").desc(), "lat", "lon").limit(top_k)


def hotspots_forecast_or_frequency(df: DataFrame, model, top_k: int = TOP_K,
                                   bin_size: float = BIN_SIZE, target_year: int = TARGET_YEAR):
    """Next-year hotspots by ``model``, falling back to the frequency ranking
    when there is none or no cell has a usable series (then the forecast is
    empty). Returns ``(points, method_name)``; the name is the one of the
    model used. The forecast's at most ``top_k`` rows are computed once."""
    if model is not None:
        pts = hotspots_forecast(cell_year_series(df, bin_size), model, top_k, target_year)
        rows = pts.collect()  # top_k rows at most
        if rows:
            return df.sparkSession.createDataFrame(rows, pts.schema), model.method
    return hotspots_frequency(df, bin_size, top_k, target_year), METHOD_FREQUENCY
