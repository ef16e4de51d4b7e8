"""Per-cell yearly series, sliding windows and the yearly chart forecasts.

``cell_year_series`` is one hash aggregation: conditional counts for each
year of the span (map-side combined), the set of years seen (bounded by the
number of distinct years) and the mean magnitude. No year x cell cross join
is ever built.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import (BIN_SIZE, FIRST_YEAR, LAST_YEAR, MIN_YEARS, SEED, SEQUENCE_LENGTH,
                      SPLIT_MIN_ROWS, TARGET_YEAR, TRAIN_FRACTION, TYPE_HISTORICAL, TYPE_PREDICTED)
from .spatial import with_cells


def cell_year_series(df: DataFrame, bin_size: float = BIN_SIZE, first: int = FIRST_YEAR,
                     last: int = LAST_YEAR, min_years: int = MIN_YEARS) -> DataFrame:
    """``lat_bin, lon_bin, mean_mag, n_years, series array<bigint>,
    historical_count`` for cells seen in at least ``min_years`` distinct
    years (any years) with a non-zero count inside ``first..last``."""
    cells = with_cells(df.select("latitude", "longitude", "magnitude", "year"), bin_size)
    cells = cells.where(F.col("lat_bin").isNotNull() & F.col("lon_bin").isNotNull())
    yr = F.col("year")
    series = F.array(*[F.count_if(yr == F.lit(y)).cast("long") for y in range(first, last + 1)])
    agg = cells.groupBy("lat_bin", "lon_bin").agg(
        F.avg("magnitude").alias("mean_mag"),
        F.size(F.collect_set("year")).alias("n_years"),
        series.alias("series"))
    agg = agg.withColumn("historical_count",
                         F.aggregate("series", F.lit(0).cast("long"), lambda a, x: a + x))
    return agg.where((F.col("n_years") >= min_years) & (F.col("historical_count") > 0))


def minmax_scale_series(series: DataFrame, col: str = "series", out: str = "scaled") -> DataFrame:
    """Scale each series to [0, 1] by its own min/max (constant -> 0); keep
    ``s_min`` and ``s_range`` (1 for constant series) for the inverse."""
    mn = F.array_min(col).cast("double")
    rng = F.array_max(col).cast("double") - mn
    rng = F.when(rng == 0, F.lit(1.0)).otherwise(rng)
    df = series.withColumns({"s_min": mn, "s_range": rng})
    return df.withColumn(out, F.transform(col, lambda x: (x.cast("double") - F.col("s_min"))
                                          / F.col("s_range")))


def minmax_inverse(c: Column | str, s_min: str = "s_min", s_range: str = "s_range") -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col * F.col(s_range) + F.col(s_min)


def last_sequence(scaled: DataFrame, length: int = SEQUENCE_LENGTH, col: str = "scaled") -> DataFrame:
    """The last ``length`` scaled values of each series as ``x0..x{L-1}``."""
    tail = F.slice(col, -length, length)
    return scaled.withColumns({f"x{i}": F.element_at(tail, i + 1) for i in range(length)})


def sliding_sequences(scaled: DataFrame, length: int = SEQUENCE_LENGTH, col: str = "scaled",
                      keys=("lat_bin", "lon_bin")) -> DataFrame:
    """Every window of ``length`` values and the next value as target ``y``;
    index ``i`` is the window start. Generated per row (explode), no join."""
    n = F.size(col)
    starts = F.explode(F.sequence(F.lit(0), n - F.lit(length) - 1)).alias("i")
    w = scaled.where(n > length).select(*keys, col, "s_min", "s_range", starts)
    cols = {f"x{k}": F.element_at(col, F.col("i") + F.lit(k + 1)) for k in range(length)}
    cols["y"] = F.element_at(col, F.col("i") + F.lit(length + 1))
    return w.withColumns(cols).drop(col)


def split_key(keys: list[Column], seed: int = SEED) -> Column:
    """Seeded hash key of integer-valued key columns (same md5 in SQL)."""
    parts = [k.cast("long").cast("string") for k in keys] + [F.lit(str(seed))]
    return F.md5(F.concat_ws(":", *parts))


def train_test_split(df: DataFrame, key: Column, train_fraction: float = TRAIN_FRACTION,
                     min_rows: int = SPLIT_MIN_ROWS) -> DataFrame:
    """Exact-size seeded split: ``is_test`` for the ``ceil((1-f) * n)`` rows
    with the smallest hash key when ``n > min_rows``; otherwise every row is
    both train and test (``is_test = 1`` and ``is_train = 1``).

    The last test row's key is looked up by counting passes when called (see
    ``selection``); flagging the rows is one map-only pass, unless rows with
    the same hash key stand on both sides of the split (then one range exchange)."""
    from .ordering import with_position
    from .selection import first_rows
    from .topk import hash_order
    n = df.count()
    if n <= min_rows:
        return df.withColumns({"is_test": F.lit(1), "is_train": F.lit(1)})
    n_test = math.ceil(float(n) * (1.0 - train_fraction))
    picked = first_rows(df, hash_order(key), n_test)[1]
    if picked is None:  # rows with the key at the split: number them all
        ranked = with_position(df.withColumn("_k", key), [F.col("_k")], pos="_r")
        is_test = (F.col("_r") < n_test).cast("int")
        return ranked.withColumns({"is_test": is_test, "is_train": 1 - is_test}).drop("_k", "_r")
    is_test = F.coalesce(picked, F.lit(False)).cast("int")
    return df.withColumns({"is_test": is_test, "is_train": 1 - is_test})


def training_workload(series: DataFrame, length: int = SEQUENCE_LENGTH, batch: int = 32,
                      epochs: int = 30) -> DataFrame:
    """cells, sequences = sum(max(0, len - L)), batches per epoch =
    max(1, sequences // batch), total batches."""
    agg = series.agg(F.count(F.lit(1)).alias("cells"),
                     F.sum(F.greatest(F.lit(0), F.size("series") - F.lit(length))).cast("long")
                     .alias("sequences"))
    seqs = F.coalesce(F.col("sequences"), F.lit(0).cast("long"))
    per = F.greatest(F.lit(1).cast("long"), F.floor(seqs / F.lit(batch)).cast("long"))
    return agg.select("cells", seqs.alias("sequences"), per.alias("batches_per_epoch"),
                      (per * F.lit(epochs)).alias("total_batches"))


# ---------------------------------------------------------------------------
# Yearly chart (global counts per year, 2008..target)
# ---------------------------------------------------------------------------
def _recent(yearly: DataFrame, n: int = 5) -> DataFrame:
    """1 row: the sorted (year, frequency) list of the last n observed years
    (all of them when there are fewer)."""
    last = yearly.orderBy(F.col("year").desc()).limit(n)
    return last.agg(F.sort_array(F.collect_list(F.struct("year", "frequency"))).alias("obs"))


def yearly_trend_forecast(yearly: DataFrame, n: int = 5) -> DataFrame:
    """1 row ``forecast``: with >= n observed years, the last n give
    ``round(mean + slope)`` (= ``round(sum(i * y_i) / 10)`` for n = 5, exact
    integers) when not constant, else ``round(mean)``; with fewer years
    ``round(mean)``; none -> 0. Half-to-even rounding."""
    obs = F.col("obs")
    k = F.size(obs)
    last = F.slice(obs, -n, n)
    freqs = F.transform(last, lambda s: s["frequency"].cast("double"))
    total = F.aggregate(freqs, F.lit(0.0), lambda a, x: a + x)
    # least squares on idx 0..n-1: mean + slope = sum(w_i * y_i) / sxx with
    # w_i = sxx / n + (i - (n-1)/2); for n = 5 the weights are 0..4, sxx = 10
    centred = [(i - (n - 1) / 2.0) for i in range(n)]
    sxx = sum(c * c for c in centred)
    weights = [sxx / n + c for c in centred]
    num = reduce(lambda a, b: a + b,
                 [F.element_at(freqs, i + 1) * F.lit(float(weights[i])) for i in range(n)])
    trend = F.rint(num / F.lit(sxx))
    constant = F.array_min(freqs) == F.array_max(freqs)
    all_mean = F.aggregate(F.transform(obs, lambda s: s["frequency"].cast("double")),
                           F.lit(0.0), lambda a, x: a + x) / k.cast("double")
    pred = (F.when(k == 0, F.lit(0.0))
            .when(k < n, F.rint(all_mean))
            .when(constant, F.rint(total / F.lit(float(n))))
            .otherwise(trend))
    return _recent(yearly, n).select(pred.cast("long").alias("forecast"))


def yearly_mean_forecast(yearly: DataFrame, n: int = 5) -> DataFrame:
    """1 row ``forecast``: round(mean of the last n observed years) (all years
    when fewer), 0 when none."""
    obs = F.col("obs")
    k = F.size(obs)
    pick = F.when(k >= n, F.slice(obs, -n, n)).otherwise(obs)
    freqs = F.transform(pick, lambda s: s["frequency"].cast("double"))
    total = F.aggregate(freqs, F.lit(0.0), lambda a, x: a + x)
    pred = F.when(k == 0, F.lit(0.0)).otherwise(F.rint(total / F.size(freqs).cast("double")))
    return _recent(yearly, n).select(pred.cast("long").alias("forecast"))


def year_spine_join(spark_df: DataFrame, yearly: DataFrame, first: int = FIRST_YEAR,
                    target: int = TARGET_YEAR) -> DataFrame:
    """All years ``first..target`` left-joined to observed counts; missing ->
    0, type Historical."""
    spark = spark_df.sparkSession
    spine = spark.range(first, target + 1).select(F.col("id").cast("int").alias("year"))
    return (spine.join(yearly.select("year", "frequency"), "year", "left")
            .select("year", F.coalesce("frequency", F.lit(0).cast("long")).alias("frequency"),
                    F.lit(TYPE_HISTORICAL).alias("type")))


def upsert_forecast_year(chart: DataFrame, forecast: DataFrame, target: int = TARGET_YEAR) -> DataFrame:
    """Replace the target-year row by the forecast (type Predicted). The
    spine already holds the target year; the forecast enters as a scalar."""
    f = forecast.select("forecast").scalar()
    is_t = F.col("year") == F.lit(target)
    return chart.select("year",
                        F.when(is_t, f).otherwise(F.col("frequency")).cast("long").alias("frequency"),
                        F.when(is_t, F.lit(TYPE_PREDICTED)).otherwise(F.col("type")).alias("type"))


def forecast_chart_table(df: DataFrame, method: str = "trend", first: int = FIRST_YEAR,
                         last: int = LAST_YEAR, target: int = TARGET_YEAR) -> DataFrame:
    """``year, frequency, type`` for first..target; the target row holds the
    trend (learned method) or mean (frequency method) forecast."""
    yearly = (df.where(F.col("year").between(first, last)).groupBy("year")
              .agg(F.count(F.lit(1)).alias("frequency")))
    fc = yearly_trend_forecast(yearly) if method == "trend" else yearly_mean_forecast(yearly)
    return upsert_forecast_year(year_spine_join(df, yearly, first, target), fc, target)


def history_summary(chart: DataFrame) -> DataFrame:
    """Over Historical rows: total, mean (zero years included), max and the
    first year reaching it."""
    h = chart.where(F.col("type") == F.lit(TYPE_HISTORICAL))
    first_max = F.min(F.struct((-F.col("frequency")).alias("nf"), F.col("year").alias("y")))
    return h.agg(F.sum("frequency").cast("long").alias("total"), F.avg("frequency").alias("mean"),
                 F.max("frequency").alias("max_frequency"), first_max["y"].alias("max_year"))


def forecast_delta(chart: DataFrame, target: int = TARGET_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """forecast, last-year value (0 when absent), change, percent (0 when the
    last year is 0)."""
    pred = F.max(F.when((F.col("type") == TYPE_PREDICTED) & (F.col("year") == target), F.col("frequency")))
    prev = F.coalesce(F.max(F.when((F.col("type") == TYPE_HISTORICAL) & (F.col("year") == last),
                                   F.col("frequency"))), F.lit(0).cast("long"))
    agg = chart.agg(pred.alias("forecast"), prev.alias("last_value"))
    change = F.col("forecast") - F.col("last_value")
    pct = F.when(F.col("last_value") > 0, change.cast("double") / F.col("last_value") * F.lit(100.0)) \
        .otherwise(F.lit(0.0))
    return agg.select("forecast", "last_value", change.alias("change"), pct.alias("change_pct"))
