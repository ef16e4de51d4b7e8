import sys
import os

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    import tempfile
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("sismo-llm-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sismo-llm-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts; ids count from 0."""
    def of(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, DOCS)
    return of


@pytest.fixture(scope="session")
def sample():
    """Texts of the smallest documents table, by id."""
    import duckdb
    return dict(duckdb.sql("select doc_id, text from read_parquet('/root/testdata/sf0.001/documents.parquet') order by 1").fetchall())
