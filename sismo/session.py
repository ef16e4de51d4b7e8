"""Session helpers: building a local session for tests/bench and finding the
shared scratch folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: str | None = None
_WRITTEN: list[str] = []


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "sismo") -> SparkSession:
    """Session for tests and bench runs. A cluster job gets its session from
    the launcher instead; nothing here is required by the operators."""
    master = master or os.environ.get("SISMO_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SISMO_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir). Only a local master (tests, bench) gets a folder of its
    own when neither is set; on a cluster that is an error, since executors
    would each write to their own disk.
    """
    global _LOCAL_SCRATCH
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir.rstrip("/")
    ctx_dir = sc.getCheckpointDir()
    if ctx_dir:
        return ctx_dir.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _LOCAL_SCRATCH is None:
        _LOCAL_SCRATCH = tempfile.mkdtemp(prefix="sismo-ckpt-")
    sc.setCheckpointDir(_LOCAL_SCRATCH)
    return _LOCAL_SCRATCH


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder, remembered
    until ``drop_scratch`` or ``release_scratch``."""
    path = f"{checkpoint_dir(spark)}/sismo-{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append(path)
    return path


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later read needs."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def release_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table of this process. Call it once the
    results that read them have been written."""
    drop_scratch(spark, *list(_WRITTEN))


@contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes, at the end, the intermediate tables written inside: for a
    caller that has written or collected its results by then."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        drop_scratch(spark, *[p for p in _WRITTEN if p not in before])


def cut_lineage(df, name: str = "table"):
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and read it back (never ``localCheckpoint``): one write job, survives
    executor loss, and keeps iterative plans short. Unlike
    ``Dataset.checkpoint`` it does not recompute the plan after the first
    action to write the checkpoint files."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one job, dropped one by one or on exit.

    ``keep`` writes a frame and returns the frame that reads it; ``drop``
    deletes such tables as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            if id(f) in self._paths:
                drop_scratch(self.spark, self._paths.pop(id(f))[1])
