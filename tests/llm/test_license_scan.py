import re

import duckdb

from sismo.llm import license_scan as ls


def brute(texts):
    out = []
    for d, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = []
        for label, words, at, key, base in ls.template_rows():
            for p in range(len(w)):
                if w[p:p + len(key)] == key:
                    same = sum(0 <= p - at + j < len(w) and w[p - at + j] == x for j, x in enumerate(words))
                    hits.append((p, label, base, same / len(words)))
        b = [h for h in hits if h[2]]
        out.append((d, len(w), len(b), min((h[0] for h in b), default=None), max((h[0] for h in b), default=None),
                    ",".join(sorted({h[1] for h in b})), ",".join(sorted({h[1] for h in hits})),
                    max((h[3] for h in hits), default=0.0), len(hits) - len(b)))
    return out


TEXTS = ["", None, "Licensed under CC BY-NC 4.0.", "all rights reserved All Rights\nReserved. all all rights reserved",
         "This work is licensed under the GNU General Public License, version 3.", "general public licence", "Kelvin ccK by", "CC",
         "by cc", "reserved", "é ñ MIT licenseé the mit license", " cc-by ", "2.0 Apache License, Version 2.0 cc by cc by",
         "x " * 40000 + "the MIT License" + " y" * 40000, "licenſe public general public license", "cc by cc by cc by 4.0"]


def rows(df):
    return [tuple(r) for r in df.orderBy("doc_id").collect()]


def test_matches_brute_force(make, sample):
    texts = TEXTS + list(sample.values())
    assert rows(ls.license_scan(make(texts))) == brute(texts)


def test_oracle_sql(make, sample):
    import pandas as pd
    texts = TEXTS + list(sample.values())
    con = duckdb.connect()
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con.register("documents", documents)
    assert con.execute(ls.oracle() + " order by doc_id").fetchall() == brute(texts)


def test_edges(make):
    assert ls.license_scan(make([])).collect() == []
    clash = make(["cc by", "cc by"], [3, 3]).selectExpr("*", "1 as words", "2 as rare", "3 as hits", "4 as t")
    assert [tuple(r)[:3] for r in ls.license_scan(clash).collect()] == [(3, 2, 1)] * 2


def test_no_python_in_the_plan(make):
    plan = ls.license_scan(make(["cc by"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
