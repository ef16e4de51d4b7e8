import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from sismo.llm import spelling as sp

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    form, count = {}, {}
    for w in n:
        others = [o for o in n if abs(len(o) - len(w)) < 2 and near(o, w)]
        count[w] = len(others)
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w
    return sorted((w, form[w], root(w), n[w], count[w], n[form[w]] if form[w] else None) for w in n)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def texts(docs=120, seed=1):
    rnd = random.Random(seed)
    stem = ["".join(rnd.choices("abcdeéfgÀß÷", k=rnd.randrange(5, 9))) for _ in range(25)]
    vocab, weight = [], []
    for w in stem:
        vocab.append(w)
        weight.append(200)
        for _ in range(6):
            k = rnd.randrange(len(w) + 1)
            v = rnd.choice([w[:k] + rnd.choice("abcéÿ") + w[k:], w[:k] + w[k + 1:], w[:k] + rnd.choice("abcxé") + w[k + 1:]])
            vocab += [v, v.capitalize()]
            weight += [rnd.choice([1, 3, 20])] * 2
    sep = [" ", "\n", "1", "—", "Ł", "日"]
    return ["".join(w + rnd.choice(sep) for w in rnd.choices(vocab, weight, k=rnd.randrange(0, 200))) for _ in range(docs)]


def test_matches_brute_force(make):
    t = texts()
    rows = list(enumerate(t)) + [(None, t[0]), (7, t[1]), (8, None), (9, ""), (10, "Ã" * 3000), (11, "aabbaa aabba " * 9)]
    df = make([x for _, x in rows], [i for i, _ in rows]).selectExpr("*", "1 as word", "2 as n", "3 as root")
    assert got(sp.spelling_variants(df)) == brute(rows)


def test_several_rounds_and_full_filters(make, monkeypatch):
    t = texts(seed=2)
    monkeypatch.setattr(sp, "FILTER_BYTES", 200)  # several rounds
    assert got(sp.spelling_variants(make(t))) == brute(list(enumerate(t)))


def test_false_positives_are_removed(make, monkeypatch):
    t = texts(docs=60, seed=3)
    monkeypatch.setattr(sp, "BITS", 1)
    assert got(sp.spelling_variants(make(t))) == brute(list(enumerate(t)))


def test_edit_hashes_follow_from_the_word(make):
    words = ["aabbcé", "zzzzzzz", "abcdefgh", "àáâãäå"]
    for rows, points in sp.matrices(pa.array(words)).values():
        class All(sp.Filters):
            seen = {}

            def has(self, length, raw):
                All.seen.setdefault(length, []).append(raw)
                return np.ones(raw.shape, bool)
        n = points.shape[1]
        r, place, code = sp.positives(points, All({n: np.zeros(1), n - 1: np.zeros(1)}, 1, 0))
        edits = [words[rows[a]][:k] + (chr(c) if c else "") + words[rows[a]][k + 1:] for a, k, c in zip(r, place, code)]
        assert len(set(zip(r.tolist(), edits))) == len(edits)
        for w in {words[i] for i in rows}:
            want = {w[:k] + w[k + 1:] for k in range(n)} | {w[:k] + chr(c) + w[k + 1:] for k in range(n) for c in sp.ALPHABET if c > ord(w[k])}
            assert want == {e for a, e in zip(r, edits) if words[rows[a]] == w}
        for length in (n, n - 1):
            have = {int(x) for part in All.seen[length] for x in part.ravel()}
            assert {int(sp.raw_hash(next(iter(sp.matrices(pa.array([e])).values()))[1])[0]) for e in edits if len(e) == length} <= have


def test_crc_of_many_runs():
    rnd = random.Random(4)
    parts = [bytes(rnd.choices(range(256), k=k)) for k in (0, 1, 5, 63, 64, 65, 300)]
    buf = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    state = np.array([zlib.crc32(b"%d:" % i) for i in range(len(parts))], np.uint32)
    assert sp.crc_after(state, buf, end - [len(p) for p in parts], end).tolist() == [zlib.crc32(b"%d:" % i + p) for i, p in enumerate(parts)]


def test_oracle():
    t = texts(docs=60, seed=5)
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": range(len(t)), "text": t}))
    assert sorted(db.sql(sp.oracle()).fetchall()) == brute(list(enumerate(t)))


def test_edges(make):
    assert got(sp.spelling_variants(make([]))) == []
    assert got(sp.spelling_variants(make(["short ab", None]))) == []
    chain = " ".join(["aaaaaa"] * 5 + ["aaaaab"] * 30 + ["aaaabb"] * 160 + ["aaabbb"] * 900)
    assert got(sp.spelling_variants(make([chain], [3]))) == brute([(3, chain)])
