import random

import duckdb
import pytest
from .test_decontam import brute as leaks
from .test_ngram_join import brute as classes
from .test_packing import check, plain

import corpus_pipeline as cp
from sismo.llm import pii, quality

SF = "/root/testdata/sf0.001"


def good(t):
    import zstandard
    z = zstandard.ZstdCompressor(level=quality.LEVEL)
    w = (t or "").split()
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    cover = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    data = (t or "").encode()
    return len(w) >= 20 and 100 * len(cover) <= 30 * len(w) and quality.in_bands(len(data), *quality.ratios(data, z))


def test_stages_and_run(spark):
    con = duckdb.connect()
    rows = dict(con.execute(f"select doc_id, text from read_parquet('{SF}/documents.parquet') order by 1").fetchall())
    bench = con.execute(f"select item_id, text from read_parquet('{SF}/benchmark.parquet')").fetchall()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns

    def stage(k, docs):
        out = cp.STAGES[k][1](spark, docs, SF)
        assert out.columns == columns
        out = spark.createDataFrame(out.collect(), docs.schema)
        return out, {r.doc_id: r.text for r in out.collect()}

    docs, got = stage(0, docs)
    rows = {d: t for d, t in rows.items() if good(t)}
    assert got == rows
    docs, got = stage(1, docs)
    rows = {d: rows[d] for d, c, _ in classes(list(rows.values()), list(rows)) if d == c}
    assert got == rows
    docs, got = stage(2, docs)
    ids = list(rows)
    rows = {ids[i]: rows[ids[i]] for i, items, _ in leaks(list(rows.values()), bench) if not items}
    assert got == rows
    field = pii.fit(docs)
    docs, got = stage(3, docs)
    assert set(got) == set(rows)
    for d, t in rows.items():
        assert not pii.base_spans(got[d]) and (pii.base_spans(t) or got[d] == t or field is not None)
    last = cp.STAGES[4][1](spark, docs, SF).collect()
    check(last, plain(list(got.values()), list(got)))
    run = cp.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in run) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in last)


def test_edges(spark, make):
    empty = make([])
    for _, f in cp.STAGES:
        assert f(spark, empty, SF).collect() == []
    rnd = random.Random(2)
    t = " ".join("".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 9))) for _ in range(60)) + " mail a@b.cd"
    docs = make([t, t, None, t], [1, 1, 2, None]).selectExpr("*", "1 as key", "2 as node", "3 as items")
    for _, f in cp.STAGES[:4]:
        docs = f(spark, docs, SF)
    rows = docs.collect()
    assert docs.columns[-3:] == ["key", "node", "items"] and [r.doc_id for r in rows] == [1]  # the row without an id is a copy
    assert all(r.text.endswith("<EMAIL>") and r.n_chars == len(r.text) for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stage_names(name):
    assert len(name) <= 40
