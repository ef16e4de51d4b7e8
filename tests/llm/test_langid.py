import zlib

import numpy as np
import pyarrow as pa
import pytest

from sismo.llm import langid as li


@pytest.fixture(scope="module")
def table():
    import duckdb
    return duckdb.sql("select doc_id, text, lang from read_parquet('/root/testdata/sf0.01/documents.parquet')").fetchall()


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


@pytest.fixture(scope="module")
def model(table):
    rows = [r for r in table if not held(r[0])]
    return li.train([r[1] for r in rows], [r[2] for r in rows])


def test_held_out_accuracy(spark, table, model):
    df = spark.createDataFrame(table, "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in li.identify_language(df, model).collect()}
    assert all(rows[d].held_out == held(d) for d, _, _ in table)
    out = [(rows[d].lang_pred, lang, rows[d].rejected) for d, _, lang in table if held(d)]
    assert np.mean([p == x for p, x, _ in out]) > 0.95
    accepted = [p == x for p, x, r in out if not r]
    assert len(accepted) > 0.5 * len(out) and np.mean(accepted) > 0.95


def test_grams_against_a_plain_loop():
    texts = ["Hé, ab 1c", "", "x", "ß-ü a"]
    buf, off = li.lowered(pa.array(texts, pa.large_string()))
    got = {k: [] for k in li.ORDERS}
    for k, (bucket, ok) in zip(li.ORDERS, li.grams(buf, off)):
        got[k] = bucket[ok].tolist()
    for k in li.ORDERS:
        want = []
        for t in texts:
            b = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in t.lower().encode())
            for i in range(len(b) - k + 1):
                if b[i:i + k].strip():
                    h = sum(c * int(m) for c, m in zip(b[i:i + k], li._MUL)) % 2**32
                    want.append(((h ^ (h >> 15)) * (0x2C1B3C6D + 2 * (k - 1)) % 2**32) >> (32 - li.BITS))
        assert got[k] == want


def test_prediction_is_the_average_of_embeddings(model, table):
    text = table[3][1]
    (at, share), = li.bags([text])
    logits = share @ model.table[at] + model.bias
    p = li._softmax(logits / model.heat)
    buf, off = li.lowered(pa.array([text, "zz", text], pa.large_string()))
    best, score = li.predict(model, buf, off)
    assert best[0] == best[2] == p.argmax() and abs(score[0] - p.max()) < 1e-4 and abs(score[2] - score[0]) < 1e-6


def test_edges(make, model, spark):
    df = make(["", None, "12 !? 5", "— …", "é", "the thing and that"] + ["x " * 60000]).selectExpr("*", "1 as score")
    rows = [(r.lang_pred, r.score) for r in li.identify_language(df, model).orderBy("doc_id").collect()]
    assert rows[:4] == [("und", 0.0)] * 4 and all(x in model.langs and 0 <= s <= 1 for x, s in rows[4:])
    assert li.identify_language(make([]), model).collect() == []
    unlabelled = make(["a b"]).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))
    assert [r.lang_pred for r in li.identify_language(unlabelled).collect()] == ["und"]


def test_learns_only_from_the_training_folds(spark, table):
    """Labels of held-out rows do not change anything."""
    small = table[:150]
    wrong = [(d, t, "xx" if held(d) else x) for d, t, x in small]
    a, b = (li.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() for rows in (small, wrong))
    assert sorted(a) == sorted(b)


def test_every_labelled_row_counts_in_a_large_table(spark, monkeypatch):
    """Few labels among many rows, more rows than any sample takes."""
    seen = []
    monkeypatch.setattr(li, "train", lambda texts, langs: seen.extend(zip(langs, texts)))
    n = 300_000
    df = spark.range(n).selectExpr("id as doc_id", "concat('text ', id) as text", "case when id % 7500 = 1 then 'aa' when id % 2 = 0 then 'bb' end as lang")
    assert li.fit(df) is None
    assert sorted(t for k, t in seen if k == "aa") == sorted(f"text {i}" for i in range(1, n, 7500) if not held(i))
    both = [t for k, t in seen if k == "bb"]
    hashes = df.where("lang = 'bb'").where(~li.held_out()).selectExpr("text", "xxhash64(doc_id) as h").orderBy("h").limit(li.PER_LANG).collect()
    assert sorted(both) == sorted(r.text for r in hashes)


def test_long_and_repeated_texts_train(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(li, "train", lambda texts, langs: seen.extend(zip(langs, texts)))
    long = " ".join(f"w\u00e9{i}" for i in range(9000))
    ids = [i for i in range(40) if not held(i)]
    rows = [(i, long, "aa") for i in ids[:9]] + [(ids[9], "short", "bb")] * 30 + [(None, "x", "cc"), (ids[10], None, "cc")]
    li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [t for k, t in seen if k == "bb"] == ["short"] and {k for k, _ in seen} == {"aa", "bb"}
    windows = [t for k, t in seen if k == "aa"]
    assert len(windows) == 9 and all(len(t) == li.TRAIN_CHARS and t in long for t in windows) and len(set(windows)) > 5
