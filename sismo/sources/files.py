"""File sources and sinks: catalogue CSV/Parquet, feature CSV, prediction
documents (JSON), scaler statistics and network weights (Parquet). Documents,
statistics and weights are replaced by a versioned publish (see ``publish``)."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.parse import nan_to_null, parse_datetime_coerce, parse_datetime_strict, to_numeric_coerce
from ..schema import FEATURES, METHOD_UNKNOWN, PREDICTION_DOC_SCHEMA, REQUIRED_COLUMNS
from .positions import parquet_positions, text_positions
from .publish import current, publish


class MissingColumns(ValueError):
    pass


def _first_line(spark: SparkSession, uri: str) -> str:
    """First line of a (maybe compressed) file that is not blank, as Spark's
    own reader takes it for the header; empty when there is none."""
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    raw = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(raw if codec is None else codec.createInputStream(raw), "UTF-8"))
        line = lines.readLine()
        while line is not None and not line.strip():
            line = lines.readLine()
        return line or ""
    finally:
        raw.close()


def _plain(uri: str, spark: SparkSession) -> str:
    """A file's address as a reader's path: no escapes, no pattern signs."""
    jvm = spark._jvm
    return re.sub(r"([\[\]{}*?])", r"\\\1", jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString())


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def _text_scans(spark: SparkSession, path: str, required) -> list[DataFrame]:
    """Header CSV files as scans with every column as text, one scan for all
    files of one header line. The first lines are read by the driver, as
    footers are. A file that lacks a required column raises."""
    files = spark.read.text(path).inputFiles()
    with ThreadPoolExecutor(16) as pool:
        heads = list(pool.map(lambda f: _first_line(spark, f), files))
    groups: dict[str, list[str]] = {}
    for f, h in zip(files, heads):
        if h:
            groups.setdefault(h, []).append(f)
    reader = spark.read.option("header", True).option("inferSchema", False)
    if len(groups) < 2:
        scans = [reader.csv(path)]
    else:
        if _is_folder(spark, path):
            reader = reader.option("basePath", path)  # folders such as year=2020 stay columns
        scans = [reader.csv([_plain(f, spark) for f in fs]) for fs in groups.values()]
    for raw, fs in zip(scans, list(groups.values()) or [[path]]):
        missing = [c for c in required if c not in raw.columns]
        if missing:
            raise MissingColumns(f"{fs[0]} lacks required columns: {missing}")
    return scans


def _by_name(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def read_catalog(spark: SparkSession, path: str, fmt: str = "csv", strict: bool = False) -> DataFrame:
    """Read an event catalogue written as text (CSV with header) or Parquet:
    one file or a folder, whose files may order their columns differently and
    hold different extra ones.

    Columns are found by name in each file; extra ones are kept (null for files
    without them). CSV columns are read as text (no inference pass) and coerced:
    numbers by ``try_cast`` (bad -> null), datetimes by the mixed-format parser
    (``strict`` fails the query on a bad datetime, otherwise it becomes null).

    Without ``event_id`` in any file the rows are numbered from 0 in stored
    order (files by path, rows as they stand; see ``sources.positions``). When
    some files have it, rows of the others get the numbers that follow the
    largest id, in the same order. A file without a required column raises."""
    if fmt == "csv":
        scans = _text_scans(spark, path, REQUIRED_COLUMNS)
    else:
        scans = [spark.read.option("mergeSchema", True).parquet(path)]
        missing = [c for c in REQUIRED_COLUMNS if c not in scans[0].columns]
        if missing:
            raise MissingColumns(f"{path} lacks required columns: {missing}")
    known = ["event_id" in s.columns for s in scans]
    if not all(known):
        scans = text_positions(scans, "_pos") if fmt == "csv" else [parquet_positions(scans[0], "_pos")[0]]
    parts = []
    for raw, has_id in zip(scans, known):
        dtypes = dict(raw.dtypes)
        cols = {}
        for c in FEATURES:
            cols[c] = to_numeric_coerce(F.col(c)) if dtypes[c] == "string" else nan_to_null(F.col(c).cast("double"))
        if dtypes["datetime"] == "string":
            cols["datetime"] = (parse_datetime_strict if strict else parse_datetime_coerce)(F.col("datetime"))
        if has_id and dtypes["event_id"] == "string":
            cols["event_id"] = F.col("event_id").try_cast("long")
        parts.append(raw.withColumns(cols))
    if not any(known):
        parts = [p.withColumnRenamed("_pos", "event_id") for p in parts]
    elif not all(known):
        ids = _by_name([p.select("event_id") for p, k in zip(parts, known) if k])
        after = F.coalesce(ids.agg(F.max("event_id")).scalar(), F.lit(-1))
        parts = [(p if k else p.withColumn("event_id", after + 1 + F.col("_pos"))).drop("_pos") for p, k in zip(parts, known)]
    return _by_name(parts)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Header CSV, one file per partition (a directory, not one file)."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def read_preprocessed(spark: SparkSession, path: str) -> DataFrame:
    """The four feature columns of header CSV files, by name in each file, as
    numbers."""
    scans = _text_scans(spark, path, FEATURES)
    return _by_name([raw.select(*[to_numeric_coerce(F.col(c)).alias(c) for c in FEATURES]) for raw in scans])


POINT_FIELDS = [f.name for f in PREDICTION_DOC_SCHEMA["hotspot_points"].dataType.elementType.fields]


def write_predictions(points: DataFrame, method: str, path: str, k: int) -> str:
    """One indented JSON document ``{method, hotspot_points: [...],
    timestamp}`` with the ``k`` first points in their published order, so
    gathering them into one array is bounded; the timestamp is the write time
    in ISO format."""
    best = points.orderBy(F.col("count").desc(), "lat", "lon").limit(k)
    # ascending struct order: the largest count first, then lat, lon
    keyed = F.struct((-F.col("count")).alias("key"), *POINT_FIELDS)
    doc = best.agg(F.sort_array(F.collect_list(keyed)).alias("pts")).select(F.struct(
        F.lit(method).alias("method"), F.transform("pts", lambda s: s.dropFields("key")).alias("hotspot_points"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")).alias("doc"))
    text = F.to_json("doc", {"pretty": "true", "ignoreNullFields": "false"})
    return publish(points.sparkSession, path, lambda to: doc.select(text.alias("value")).coalesce(1).write.text(to))


def read_prediction_doc(spark: SparkSession, path: str) -> DataFrame | None:
    """The document row, or None when missing, empty or corrupt. The document
    may span many lines. Missing keys default to an empty list / "Unknown"."""
    schema = T.StructType([*PREDICTION_DOC_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    try:
        doc = (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", "_corrupt").json(current(spark, path)))
        rows = doc.limit(2).collect()  # one document: bounded by its points
    except AnalysisException:
        return None
    if len(rows) != 1 or rows[0]["_corrupt"] is not None:
        return None
    doc = spark.createDataFrame([tuple(rows[0])[:-1]], PREDICTION_DOC_SCHEMA)
    return doc.select(F.coalesce("method", F.lit(METHOD_UNKNOWN)).alias("method"),
                      F.coalesce("hotspot_points", F.array().cast(PREDICTION_DOC_SCHEMA["hotspot_points"].dataType))
                      .alias("hotspot_points"), "timestamp")


def read_predictions(spark: SparkSession, path: str) -> DataFrame | None:
    """Saved points with their 0-based ``rank`` (array position)."""
    doc = read_prediction_doc(spark, path)
    if doc is None:
        return None
    return doc.select("method", F.posexplode("hotspot_points").alias("rank", "p")).select(
        "method", F.col("rank").cast("int").alias("rank"), "p.*")


def saved_topk_slice(saved: DataFrame, k: int) -> DataFrame:
    return saved.where(F.col("rank") < k)


def reuse_predictions(spark: SparkSession, path: str, method: str, top_k: int,
                      compute: Callable[[], DataFrame], force: bool = False) -> tuple[DataFrame, bool]:
    """Use the saved points when the method matches, recomputation is not
    forced and at least ``top_k`` points are saved; else compute, save and
    return the new points. Returns (points, reused)."""
    doc = None if force else read_prediction_doc(spark, path)
    if doc is not None:
        meta = doc.select("method", F.size("hotspot_points").alias("n")).first()
        if meta is not None and meta["method"] == method and meta["n"] >= top_k:
            return saved_topk_slice(read_predictions(spark, path), top_k).drop("method"), True
    write_predictions(compute(), method, path, top_k)
    return read_predictions(spark, path).drop("method"), False


def save_scaler(stats: DataFrame, path: str) -> str:
    """Persist ``feature, mean, std`` (one row per feature)."""
    return publish(stats.sparkSession, path, lambda to: stats.coalesce(1).write.parquet(to))


def load_scaler(spark: SparkSession, path: str, fit: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Load the saved statistics; when missing, fit them (``fit``) and save."""
    try:
        return spark.read.parquet(current(spark, path))
    except AnalysisException:
        if fit is None:
            raise
        save_scaler(fit(), path)
        return spark.read.parquet(current(spark, path))


def save_model(weights: DataFrame, path: str) -> str:
    """Persist a weights table ``layer, i, j, value`` (biases at i = -1)."""
    return publish(weights.sparkSession, path, lambda to: weights.coalesce(1).write.parquet(to))


def load_model(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(current(spark, path))
    except AnalysisException:
        return None


def write_partitioned(df: DataFrame, path: str, by: str = "year", fmt: str = "csv",
                      mode: str = "overwrite") -> str:
    """Export one directory per ``by`` value (e.g. the per-year cluster
    table), so readers filtering on it prune whole directories."""
    w = df.write.mode(mode).partitionBy(by)
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))
    return path


def union_years(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Saved exports of :func:`write_partitioned` (Parquet) stacked by column
    name; a column that some of them lack is null there."""
    return _by_name([spark.read.parquet(p) for p in paths])
