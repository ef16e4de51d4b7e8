"""Versioned publish: a saved result is replaced in one step.

A result lives in a folder of its own, ``<path>/versions/<name>``, and the one-line
file ``<path>/CURRENT`` names the version that readers take. A writer writes a
new version first and then renames a finished manifest over the old one, which
the file system does at once: there is no moment without a result, a writer that
fails leaves the old one, and two writers leave one of their results whole. The
version before the current one stays for readers that have opened it; the one
before that is deleted. A path without a manifest is read as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

MANIFEST, VERSIONS = "CURRENT", "versions"


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _manifest(spark: SparkSession, path: str) -> list[str]:
    """Names of the current version and the one before it."""
    p, fs = _place(spark, f"{path}/{MANIFEST}")
    if not fs.exists(p):
        return []
    stream = fs.open(p)
    try:
        line = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return (line or "").split()


def current(spark: SparkSession, path: str) -> str:
    """Where the current version lies: ``path`` itself without a manifest."""
    names = _manifest(spark, path)
    return f"{path}/{VERSIONS}/{names[0]}" if names else path


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a new version's folder and make it the current one."""
    name = uuid.uuid4().hex
    write(f"{path}/{VERSIONS}/{name}")
    before = _manifest(spark, path)
    fresh, fs = _place(spark, f"{path}/.{MANIFEST}-{name}")
    out = fs.create(fresh, True)
    out.write(bytearray(" ".join([name, *before[:1]]).encode()))
    out.close()
    jvm = spark._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(fresh), fs.makeQualified(target), how)
    for old in before[1:]:
        p, _ = _place(spark, f"{path}/{VERSIONS}/{old}")
        fs.delete(p, True)
    return path
