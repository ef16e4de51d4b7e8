import random
import re
from collections import Counter, defaultdict
from itertools import product

import duckdb
import pyarrow as pa

from sismo.llm import divergence as dv

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, at_least=10, top=10):
    docs, n, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for r, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text or "")):
            docs[lang, w].add(r)
            n[lang, source][w] += 1
    out = []
    for lang, sources in groups.items():
        kept = sorted(w for (x, w), d in docs.items() if x == lang and len(d) >= at_least)

        def p(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}
        q = p(sum((n[lang, s] for s in sources), Counter()))
        each = {s: p(n[lang, s]) for s in sources}

        def f(x, y):
            return (x - y) ** 2 // (x + y)
        for s in sources:
            lists = {"pair": [(o, sum(f(each[s][w], each[o][w]) for w in kept)) for o in sources if o != s],
                     "term": [(w, f(each[s][w], q[w])) for w in kept if n[lang, s][w] and each[s][w] > q[w]]}
            for part, items in lists.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")


def fixture(sources=5, docs=160, seed=1):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdéfABCß", k=rnd.randrange(1, 5))) for _ in range(60)] + ["x1y", "ab-cd", "日本"]
    rows = []
    for i in range(docs):
        s = rnd.randrange(sources)
        words = rnd.choices(vocab[s:s + 40], k=rnd.randrange(0, 60))
        rows.append((rnd.choice([" ", "\n", ". "]).join(words), rnd.choice(["de", "en", "en", None]), f"s{s}" if s else None))
    return rows + [(None, "fr", "a"), ("", "fr", "b"), ("only one", "it", "z"), ("x" * 50_000, "en", "s9")] + rows[:20]


def test_matches_brute_force(spark):
    rows = fixture()
    assert got(dv.source_divergence(frame(spark, rows))) == brute(rows)


def test_many_cells_give_the_same_rows(spark):
    rows = fixture(sources=9, seed=2)
    assert got(dv.source_divergence(frame(spark, rows), block_size=2, term_block=7)) == brute(rows)


def test_oracle(spark, tmp_path):
    rows = fixture(seed=4)
    db = duckdb.connect()
    db.register("documents", pa.table({c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(("text", "lang", "source"))}))
    assert sorted(db.sql(dv.oracle()).fetchall()) == brute(rows)


def test_probability_is_exact(spark):
    cases = [(0, 0, 1), (5, 7, 3), (10**13, 3 * 10**13, 10**9), (333, 1000, 7), (10**12 - 1, 10**12, 12345), (0, 0, 0)]
    df = spark.createDataFrame(cases, "c long, n long, v long").select("*", dv.probability(*map(dv.F.col, "cnv")).alias("p"))
    for r in df.collect():
        assert r.p == (1 + 10**9 * (r.c + 2) // (r.n + 2 * r.v) if r.n + 2 * r.v else 1)


def test_edges(spark):
    assert got(dv.source_divergence(frame(spark, []))) == []
    rows = [("same words here", "en", s) for s, _ in product("ab", range(6))]
    df = frame(spark, rows).selectExpr("*", "1 as term", "2 as value", "'x' as part")
    assert got(dv.source_divergence(df)) == brute(rows)
    assert dv.source_divergence(df).columns == COLUMNS
