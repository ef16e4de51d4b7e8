"""Versioned publish and the stateful stream."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sismo.operators import net
from sismo.operators import scale as sc
from sismo.operators.anomaly import anomaly_threshold
from sismo.schema import FEATURES
from sismo.sources import files as io
from sismo.sources import fixtures as fx
from sismo.sources.publish import current, publish
from sismo.streaming.score import running_threshold, score_records, stream_score_running

from conftest import SF_SMALL


def _tmp(name):
    return os.path.join(tempfile.mkdtemp(prefix="sismo-publish-"), name)


def put(spark, path, n):
    publish(spark, path, lambda to: spark.range(n).write.parquet(to))


def test_a_reader_is_never_without_a_result(spark):
    path = _tmp("r")
    put(spark, path, 3)
    opened = spark.read.parquet(current(spark, path))
    seen = []

    def slow(to):
        seen.append(spark.read.parquet(current(spark, path)).count())  # while the new one is being written
        spark.range(5).write.parquet(to)
        seen.append(spark.read.parquet(current(spark, path)).count())
    publish(spark, path, slow)
    assert seen == [3, 3] and opened.count() == 3 and spark.read.parquet(current(spark, path)).count() == 5
    put(spark, path, 7)
    assert len(os.listdir(f"{path}/versions")) == 2  # the current one and the one before


def test_a_failing_writer_leaves_the_old_result(spark):
    path = _tmp("r")
    put(spark, path, 3)

    def broken(to):
        spark.range(1).write.parquet(to)
        raise RuntimeError("stopped")
    with pytest.raises(RuntimeError):
        publish(spark, path, broken)
    assert spark.read.parquet(current(spark, path)).count() == 3


def test_writers_do_not_interleave(spark):
    path = _tmp("r")
    put(spark, path, 3)

    def other_in_between(to):
        spark.range(5).write.parquet(to)
        put(spark, path, 9)
    publish(spark, path, other_in_between)
    assert spark.read.parquet(current(spark, path)).count() == 5


def test_paths_without_a_manifest_are_read_as_they_are(spark):
    path = _tmp("plain")
    spark.createDataFrame([("magnitude", 1.0, 2.0)], "feature string, mean double, std double").write.parquet(path)
    assert io.load_scaler(spark, path).count() == 1


def test_replayed_records_change_nothing_and_the_threshold_is_the_batch_one(spark):
    cat = fx.catalog(spark, SF_SMALL)
    stats = sc.fit_standard(cat.dropna(subset=list(FEATURES)))
    params = net.rule_params((4, 6, 3, 6, 4))
    src, sink, ck, state = _tmp("in"), _tmp("out"), _tmp("ck"), _tmp("state")
    cat.where("event_id % 2 = 0").repartition(3).write.parquet(src)
    args = (spark, src, sink, ck, state, stats, params, "10000 days")
    stream_score_running(*args, max_files=1)
    before = running_threshold(spark, state).first()
    cat.where("event_id % 4 = 0").repartition(1).write.mode("append").parquet(src)  # a replay
    stream_score_running(*args, max_files=1)
    assert running_threshold(spark, state).first() == before
    cat.where("event_id % 2 <> 0").repartition(2).write.mode("append").parquet(src)
    stream_score_running(*args, max_files=2)
    want = score_records(cat.where("datetime is not null"), stats, params)
    end, batch = running_threshold(spark, state).first(), anomaly_threshold(want).first()
    assert end.n == want.count() and abs(end.threshold - batch.threshold) < 1e-9 * abs(batch.threshold)
    out = spark.read.parquet(sink)
    assert out.count() == out.select("event_id").distinct().count() == want.count()
    assert out.where(F.col("is_anomaly").isNull()).count() == 0
