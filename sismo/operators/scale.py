"""Feature scaling fitted by one aggregate pass.

MLlib's ``StandardScaler`` divides by the *sample* std and its
``MinMaxScaler`` maps a constant column to 0.5; the reference semantics
(population std, zero std -> 1; constant -> 0) are written as aggregates.
A fitted scaler is a handful of doubles, kept on the driver and applied as
literals (the same as a broadcast of a one-row table, without a join).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES


@dataclass(frozen=True)
class StandardStats:
    cols: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]          # population std, 0 replaced by 1

    def as_rows(self) -> list[tuple[str, float, float]]:
        return list(zip(self.cols, self.mean, self.std))


@dataclass(frozen=True)
class MinMaxStats:
    cols: tuple[str, ...]
    min: tuple[float, ...]
    max: tuple[float, ...]


def standard_stats(df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """1 row per column: ``feature, mean, std`` (population std, 0 -> 1)."""
    cols = list(cols)
    agg = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c)
                   for c in cols])
    long = agg.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c + ".*"))
                                         for c in cols])))
    return long.withColumn("std", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))


def fit_standard(df: DataFrame, cols: Sequence[str] = FEATURES) -> StandardStats:
    rows = {r["feature"]: r for r in standard_stats(df, cols).collect()}
    cols = tuple(cols)
    return StandardStats(cols, tuple(float(rows[c]["mean"]) for c in cols),
                         tuple(float(rows[c]["std"]) for c in cols))


def standard_scale(df: DataFrame, stats: StandardStats, prefix: str = "") -> DataFrame:
    """Scaled columns under ``prefix`` + name; with a prefix the raw columns
    stay beside them, so nothing has to be joined back."""
    return df.withColumns({prefix + c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in stats.as_rows()})


def fit_minmax(df: DataFrame, cols: Sequence[str] = FEATURES) -> MinMaxStats:
    r = df.agg(*[F.min(c).alias(f"mn_{c}") for c in cols],
               *[F.max(c).alias(f"mx_{c}") for c in cols]).first()
    cols = tuple(cols)
    return MinMaxStats(cols, tuple(float(r[f"mn_{c}"]) for c in cols),
                       tuple(float(r[f"mx_{c}"]) for c in cols))


def minmax_scale(df: DataFrame, stats: MinMaxStats) -> DataFrame:
    """``(x - min) / (max - min)``; a constant column maps to 0."""
    out = {}
    for c, mn, mx in zip(stats.cols, stats.min, stats.max):
        rng = mx - mn
        out[c] = (F.when(F.col(c).isNotNull(), F.lit(0.0)) if rng == 0
                  else (F.col(c) - F.lit(mn)) / F.lit(rng))
    return df.withColumns(out)


def standard_scale_lazy(df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """Fit and apply in one lazy plan: every row sees the fitted mean/std as
    scalar subqueries (Spark merges them into one aggregate job and inlines
    the results) — the Spark form of broadcasting a one-row model to all
    rows, with no join."""
    cols = list(cols)
    fields = []
    for i, c in enumerate(cols):
        sd = F.stddev_pop(c)
        fields += [F.avg(c).alias(f"m{i}"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"s{i}")]
    # one aggregate, one scalar subquery (a struct), referenced per column
    model = df.agg(F.struct(*fields).alias("st")).scalar()
    return df.withColumns({c: (F.col(c) - model[f"m{i}"]) / model[f"s{i}"] for i, c in enumerate(cols)})


MODEL_NUMBERS = 200_000  # keys x features up to which a model table is broadcast


def standard_stats_by(df: DataFrame, key: str, cols: Sequence[str] = FEATURES) -> DataFrame:
    """A table of models: one row per ``key`` (a year, a cell), with the mean
    and population std (0 -> 1) of each column; one hash aggregate."""
    aggs = []
    for c in cols:
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"_m_{c}"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"_s_{c}")]
    return df.groupBy(key).agg(*aggs)


def scale_by_model(df: DataFrame, models: DataFrame, key: str, cols: Sequence[str] = FEATURES) -> DataFrame:
    """Every row scaled by the model of its key. A written (or otherwise cheap)
    model table is counted when called: while it is small it is broadcast and
    no row moves; beyond that rows and models meet by key, and adaptive
    execution splits a hot key. Rows of a null key use the null key's model;
    rows without a model get null."""
    names = {c: f"_key_{key}" if c == key else c for c in models.columns}
    table = models.select(*[F.col(c).alias(n) for c, n in names.items()])
    if models.count() * len(cols) <= MODEL_NUMBERS:
        table = F.broadcast(table)  # at most MODEL_NUMBERS numbers
    met = df.join(table, F.col(key).eqNullSafe(F.col(names[key])), "left")
    return met.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in cols}).select(*df.columns)
