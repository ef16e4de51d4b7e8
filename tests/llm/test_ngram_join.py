import random

import pytest

from sismo.llm import ngram_join as nj


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(texts, ids):
    s = [shingles(t) for t in texts]
    near = [[j for j in range(len(s)) if j != i and s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])]
            for i in range(len(s))]
    cls = list(range(len(s)))
    for i in range(len(s)):
        todo = [i]
        while todo:
            x = todo.pop()
            for y in near[x]:
                if cls[y] > cls[i]:
                    cls[y] = cls[i]
                    todo.append(y)
    return sorted((ids[i], ids[min(cls[i], i)], len(near[i])) for i in range(len(s)))


def got(df):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in df.collect())


@pytest.fixture
def family():
    """Copies, near copies in steps, short and empty texts, unrelated texts."""
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    texts = []
    for g, size in ((0, 1), (1, 90), (2, 12), (3, 2)):
        base = rnd.choices(vocab, k=120)
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append(" ".join(w))
    texts += [texts[0]] * 7 + ["one two", "one  two", "One Two", "", None, " \n "] + [" ".join(rnd.choices(vocab, k=60)) for _ in range(40)]
    return texts


def test_matches_brute_force(make, family):
    ids = list(range(len(family)))
    assert got(nj.ngram_join(make(family))) == brute(family, ids)


def test_small_buckets_and_blocks_agree(make, family, monkeypatch):
    ids = list(range(len(family)))
    monkeypatch.setattr(nj, "SMALL", 3)
    monkeypatch.setattr(nj, "BLOCK", 16)
    assert got(nj.ngram_join(make(family))) == brute(family, ids)


def test_matches_brute_force_on_the_sample(make, sample):
    texts, ids = list(sample.values()), list(sample)
    assert got(nj.ngram_join(make(texts, ids))) == brute(texts, ids)


def test_edges_of_the_input(make, spark):
    assert nj.ngram_join(make([])).collect() == []
    same = make(["a b c d e f", "a b c d e f", None], [7, 7, None])
    assert sorted(tuple(r)[:3] for r in same.transform(nj.ngram_join).where("doc_id is not null").collect()) == [(7, 7, 1), (7, 7, 1)]
    clash = make(["a b c d e f g", "a b c d e f g"]).selectExpr("*", "1 as node", "2 as key", "3 as class_id", "4 as n")
    assert got(nj.ngram_join(clash)) == [(0, 0, 1), (1, 0, 1)]


def _nulls_last(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r)))


def test_rows_without_or_with_equal_ids(make):
    base = " ".join(f"w{i}" for i in range(200))
    near, other = base + " more", " ".join(f"x{i}" for i in range(40))
    texts = [base, near, base, other, other + " y z", other, "", None, "lone text of six words here"]
    ids = [1, None, None, 1, 2, 1, 1, None, None]
    rows = _nulls_last((r.doc_id, r.class_id, r.n_links) for r in nj.ngram_join(make(texts, ids)).collect())
    assert rows == _nulls_last([(1, 1, 2), (None, 1, 2), (None, 1, 2), (1, 1, 2), (2, 1, 2), (1, 1, 2), (1, 1, 0), (None, None, 0), (None, None, 0)])
    kept = _nulls_last((r.doc_id, r.text) for r in nj.keep_one(make(texts, ids)).collect())
    assert kept == _nulls_last([(1, base), (1, other), (1, ""), (None, None), (None, texts[8])])


def test_one_row_of_each_class_stays_by_brute_force(make, family):
    rnd = random.Random(9)
    ids = [rnd.choice([None, rnd.randrange(30), 1000 + i]) for i in range(len(family))]
    s = [shingles(t) for t in family]
    cls = [c for _, c, _ in sorted(brute(family, list(range(len(family)))))]
    left = [(i, t) for i, t, x in zip(ids, family, s) if not x]
    for c in sorted({c for c, x in zip(cls, s) if x}):
        members = [(ids[j], family[j]) for j in range(len(family)) if cls[j] == c and s[j]]
        low = min((i for i, _ in members if i is not None), default=None)
        left.append((low, {t for i, t in members if i == low}))
    got_rows = [(r.doc_id, r.text) for r in nj.keep_one(make(family, ids)).collect()]
    assert len(got_rows) == len(left)
    for i, t in left:
        hit = next(r for r in got_rows if r[0] == i and (r[1] in t if isinstance(t, set) else r[1] == t))
        got_rows.remove(hit)


def test_bands_reach_the_recall():
    for t, r in ((0.8, 0.995), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = nj.bands_for(t, r)
        assert 1 - (1 - t ** rows) ** bands >= r and bands * rows <= nj.HASHES
