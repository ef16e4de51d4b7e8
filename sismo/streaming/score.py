"""Scoring incoming event records on a stream, without and with state.

The scoring transform is stateless (scale with fitted statistics, forward
pass, compare with a fitted threshold), so the same function serves a batch
DataFrame and a streaming one: no watermark or state store is involved. A
stream takes the threshold as a number (it cannot aggregate over itself
inside a stateless query); a batch may pass a scalar subquery.

``stream_score_running`` keeps state across micro-batches: Spark's state store
holds the event ids within the watermark, so a replayed record changes nothing;
the running count, mean and squared deviations of the errors, from which the
threshold follows, are a one-row table that every batch publishes anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import net
from ..operators.anomaly import ERR
from ..operators.scale import StandardStats, standard_scale
from ..schema import CATALOG_SCHEMA, FALLBACK_THRESHOLD, FEATURES, N_SIGMA
from ..session import cut_lineage
from ..sources.publish import current, publish


def score_records(records: DataFrame, stats: StandardStats, params,
                  threshold: Column | float = FALLBACK_THRESHOLD) -> DataFrame:
    """``event_id, reconstruction_error, is_anomaly`` for records with all
    four features present (batch or streaming input). The threshold defaults
    to the one saved with the original model."""
    feats = list(FEATURES)
    x = standard_scale(records.dropna(subset=feats), stats, "z_")
    scored = net.score_arrow(x, params, [f"z_{c}" for c in feats])
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return scored.select("event_id", F.col(ERR), (F.col(ERR) > thr).cast("int").alias("is_anomaly"))


def stream_score_records(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                         stats: StandardStats, params, threshold: float = FALLBACK_THRESHOLD, max_files: int = 4,
                         schema=CATALOG_SCHEMA) -> None:
    """File-source stream -> anomaly flags -> Parquet sink; runs every file
    present now (``availableNow``) in micro-batches and returns. Progress
    lives in ``checkpoint`` (shared folder), so a restarted job resumes."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
              .parquet(source_dir))
    q = (score_records(stream, stats, params, threshold).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start(sink_dir))
    q.awaitTermination()


RUNNING = "batch long, n long, mean double, m2 double"


def _merged(a: tuple, b: tuple) -> tuple:
    """(n, mean, squared deviations) of two sets of numbers together."""
    n = a[0] + b[0]
    if n == 0:
        return 0, 0.0, 0.0
    d = b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n


def running_threshold(spark: SparkSession, state_dir: str, n_sigma: float = N_SIGMA) -> DataFrame:
    """1 row: ``threshold, mean_error, std_error, n`` after the last batch."""
    std = F.sqrt(F.col("m2") / F.col("n"))
    return spark.read.schema(RUNNING).parquet(current(spark, state_dir)).select(
        (F.col("mean") + F.lit(float(n_sigma)) * std).alias("threshold"), F.col("mean").alias("mean_error"), std.alias("std_error"), "n")


def stream_score_running(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, state_dir: str,
                         stats: StandardStats, params, within: str = "30 days", n_sigma: float = N_SIGMA,
                         max_files: int = 4, schema=CATALOG_SCHEMA) -> None:
    """As ``stream_score_records``, with a threshold that the stream learns.

    Records count once: a repeated ``event_id`` whose event time lies ``within``
    the watermark is dropped, an older one comes too late and is dropped as
    well; records without a datetime are left out. Each batch adds its errors to
    the running mean and deviation and flags its rows by the threshold after
    them, into ``<sink_dir>/batch=<number>``. A batch that is run again after a
    failure writes the same folder and is added once, since the state names the
    last batch in it."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)
              .where("datetime is not null").withColumn("_at", F.col("datetime").cast("timestamp"))
              .withWatermark("_at", within).dropDuplicatesWithinWatermark(["event_id"]))

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        try:
            last, *old = session.read.schema(RUNNING).parquet(current(session, state_dir)).first()
        except AnalysisException:
            last, old = -1, (0, 0.0, 0.0)
        if number <= last:
            return
        scored = cut_lineage(score_records(batch, stats, params).drop("is_anomaly"), "scored")
        n, mean, var = scored.agg(F.count(ERR), F.avg(ERR), F.var_pop(ERR)).first()
        now = _merged(tuple(old), (n, mean or 0.0, (var or 0.0) * n))
        threshold = now[1] + n_sigma * (now[2] / now[0]) ** 0.5 if now[0] else float("inf")
        (scored.withColumn("is_anomaly", (F.col(ERR) > F.lit(threshold)).cast("int"))
         .write.mode("overwrite").parquet(f"{sink_dir}/batch={number}"))
        state = session.createDataFrame([(number, *now)], RUNNING)
        publish(session, state_dir, lambda to: state.coalesce(1).write.parquet(to))

    q = (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
