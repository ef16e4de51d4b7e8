import random
import re

import numpy as np
import pytest

from sismo.llm import decontam as dc


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", (t or "").lower()).strip(" ")


def windows(t):
    t = norm(t)
    if len(t) < dc.SHORTEST:
        return []
    if len(t) <= dc.WINDOW:
        return [t]
    s = sorted({*range(0, len(t) - dc.WINDOW + 1, dc.STRIDE), len(t) - dc.WINDOW})
    return [t[i:i + dc.WINDOW] for i in s]


def edits(pattern, text):
    """Least edits of the pattern against any region (Sellers)."""
    row = np.zeros(len(text) + 1, int)
    chars = np.array([ord(c) for c in text], int)
    j = np.arange(len(text) + 1)
    for i, p in enumerate(pattern):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (chars != ord(p)), row[1:] + 1)
        row = np.minimum.accumulate(new - j) + j
    return int(row.min())


def brute(texts, items):
    out = []
    for d, t in enumerate(texts):
        n, hit = norm(t), {}
        for i, b in items:
            for w in windows(b):
                e = edits(w, n)
                if e <= len(w) // dc.PER_EDIT:
                    hit[i] = min(e, hit.get(i, e))
        out.append((d, ",".join(map(str, sorted(hit))), min(hit.values(), default=None)))
    return out


def got(df):
    return [(r.doc_id, r.item_ids, r.min_edits) for r in df.orderBy("doc_id").collect()]


@pytest.fixture
def case():
    rnd = random.Random(3)
    syl = ["th", "er", "on", "an", "ré", "in", "the", "ed", "nd"]

    def prose(n):
        return " ".join("".join(rnd.choices(syl, k=rnd.randrange(1, 4))) for _ in range(n))
    items = [(i * 3, prose(n)) for i, n in enumerate([60, 40, 20, 9, 5, 2, 30])]
    texts = [prose(rnd.randrange(0, 120)) for _ in range(30)]
    for k in range(30):
        p = list(items[k % 7][1])
        for _ in range(rnd.randrange(0, 14)):
            i = rnd.randrange(len(p)) if p else 0
            op = rnd.random()
            if op < 0.4:
                p[i:i + 1] = [rnd.choice("xyzé")]
            elif op < 0.7:
                p[i:i + 1] = []
            else:
                p[i:i] = [rnd.choice("xyz \n")]
        cut = "".join(p).upper() if k % 5 == 0 else "".join(p)
        cut = cut[len(cut) // 3:] if k % 4 == 0 else cut
        texts.append(prose(10) + rnd.choice(["\n", " ", ""]) + cut + " " + prose(rnd.randrange(0, 20)))
    texts += ["", None, items[0][1], " \n" + items[3][1] + " ", items[2][1]]
    return texts, items


def test_matches_brute_force(spark, make, case):
    texts, items = case
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    expected = brute(texts, items)
    assert sum(1 for x in expected if x[1]) > 15
    assert [x[:2] for x in got(dc.find_contamination(make(texts), bench))] == [x[:2] for x in expected]
    assert [x[2] for x in got(dc.find_contamination(make(texts), bench))] == [x[2] for x in expected]


def test_blocks_of_the_benchmark_give_the_same(spark, make, case, monkeypatch):
    texts, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = got(dc.find_contamination(make(texts), bench))
    monkeypatch.setattr(dc, "INDEX_CHARS", 200)
    assert got(dc.find_contamination(make(texts), bench)) == whole


def test_edges(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog by the old river bank")], "item_id long, text string")
    assert dc.find_contamination(make([]), bench).collect() == []
    assert got(dc.find_contamination(make(["a", None]), none)) == [(0, "", None), (1, "", None)]
    t = "x " * 50000 + "THE quick  brown fox jumps\nover the lazy dog by the old river bank " + "y " * 50000
    df = make([t, t], [4, 4]).selectExpr("*", "1 as items", "2 as edits", "3 as item_id")
    assert got(dc.find_contamination(df, bench)) == [(4, "1", 0), (4, "1", 0)]


def letters(rnd, n):
    """n code points of words, no space at the ends or next to another."""
    out = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyzé", k=n))
    return "".join(" " if 0 < i < n - 1 and i % 6 == 5 else c for i, c in enumerate(out))


def test_items_of_every_length(spark, make):
    rnd = random.Random(8)
    items = [(n, letters(rnd, n)) for n in range(1, 81)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    # digits around them: nothing but the item itself can match
    exact = got(dc.find_contamination(make([f"12 345 {t.upper()}, 67 890" for _, t in items]), bench, short_items=True))
    for (n, _), (_, ids, least) in zip(items, exact):
        assert str(n) in ids.split(",") and least == 0, n
    changed = [(n, k) for n, _ in items for k in (1, 2, 3) if n >= dc.SHORTEST]
    texts = []
    for n, k in changed:
        t = list(items[n - 1][1])
        for j in range(k):
            t[(2 * j + 1) * n // (2 * k)] = "#"
        texts.append("12 345 " + "".join(t) + " 67 890")
    for (n, k), text, (_, ids, _) in zip(changed, texts, got(dc.find_contamination(make(texts), bench, short_items=True))):
        want = any(edits(w, norm(text)) <= min(len(w) // dc.PER_EDIT, len(w) // dc.Q - 1) for w in windows(items[n - 1][1]))
        assert (str(n) in ids.split(",")) == want, (n, k)


def test_short_items_are_whole_words(spark, make):
    bench = spark.createDataFrame([(1, "The  Cat"), (2, "9"), (3, "x = 1;"), (4, "\u732b\u306f"), (5, "the cat")], "item_id long, text string")
    texts = ["(the\ncat)", "the cats", "bathe cat", "the", "cat 9", "19 9th", "ax = 1;2", "x = 1;2", "\u9ed2\u732b\u306f\u597d", "the cat"]
    want = ["1,5", "", "", "", "2", "", "", "3", "4", "1,5"]
    assert [x[1] for x in got(dc.find_contamination(make(texts), bench, short_items=True))] == want
    clean = dc.drop_contaminated(make(texts), bench, short_items=True)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, w in enumerate(want) if not w]


def test_items_without_an_id(spark, make):
    item = "the quick brown fox jumps over the lazy dog by the old river bank"
    bench = spark.createDataFrame([(None, item), (None, "old bank"), (7, item)], "item_id long, text string")
    docs = make([f"so {item} it was", "an old bank", "nothing"])
    rows = dc.find_contamination(docs, bench, short_items=True).orderBy("doc_id").collect()
    assert [(r.contaminated, r.n_items, r.item_ids, r.min_edits) for r in rows] == [(True, 2, "7", 0), (True, 1, "", 0), (False, 0, "", None)]
    assert [r.doc_id for r in dc.drop_contaminated(docs, bench, short_items=True).collect()] == [2]
