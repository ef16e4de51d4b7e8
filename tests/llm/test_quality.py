import random
import re
from collections import Counter

import zstandard

from sismo.llm import quality as q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    runs = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(runs)
    cover = {j for i, r in enumerate(runs) if n[r] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    data, z = t.encode(), zstandard.ZstdCompressor(level=q.LEVEL)
    ratio = len(z.compress(data)) / len(data) if data else None
    n = max(1, round(len(data) / 512)) if data else 0
    parts = [data[len(data) * i // n:len(data) * (i + 1) // n] for i in range(n)] if n > 1 else []
    bad = [x for x in parts if not (0.34, 0.30)[len(x) >= 448] <= len(z.compress(x)) / len(x) <= (0.84, 0.80)[len(x) >= 448]]
    limits = next((lo, hi) for below, lo, hi in q.BANDS if below is None or len(data) < below)
    good = ratio is not None and limits[0] <= ratio <= limits[1] and 4 * sum(map(len, bad)) <= len(data)
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover), failed, not failed and good, ratio, n, len(bad))


def cases():
    rnd = random.Random(4)
    vocab = ["".join(rnd.choices("abcdefghijklé", k=rnd.randrange(1, 9))) for _ in range(900)]
    prose = [" ".join(rnd.choices(vocab, k=n)) for n in (5, 19, 20, 60, 400, 3000, 9000)]
    noise = "".join(chr(rnd.randrange(33, 127)) for _ in range(9000))
    spaced = " ".join(noise[i:i + 7] for i in range(0, 9000, 7))
    return prose + ["", None, " \n\t ", "a\nb\n a\nb\n\nb", prose[3] + "\n" + prose[3], "x " * 5000, noise, spaced,
                    prose[4] + " word" * 3000, "é# *|<> é", prose[3] * 1 + " " + prose[3], "a\x0bb\x1fc d"]


def test_matches_brute_force(make, sample):
    texts = cases() + list(sample.values())
    rows = q.quality_rules(make(texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == [brute(t) for t in texts]


def test_bands_reject_repetition_and_noise(make):
    texts = cases()
    rows = {r.doc_id: r for r in q.quality_rules(make(texts)).collect()}
    assert all(rows[i].kept for i in (3, 4, 5, 6)) and not any(rows[i].kept for i in (0, 1, 7, 8, 9, 12))
    assert not rows[14].base_failed and not rows[14].kept  # incompressible words pass the word rules only


def test_noise_in_any_part_of_a_text_rejects_it(make):
    rnd = random.Random(7)
    vocab = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randrange(2, 9))) for _ in range(800)]

    def prose(n):
        out = ""
        while len(out) < n:
            out += rnd.choice(vocab) + " "
        return out[:n]

    def noise(n):
        return "".join(chr(rnd.randrange(33, 118)) + " " * (i % 9 == 8) for i in range(n))[:n]
    texts = [prose(3000) + noise(3000), prose(4096) + noise(4096), prose(8192) + noise(3900), noise(500) + prose(900), prose(700) + noise(500),
             prose(2000) + "a b " * 300, prose(3000), prose(12000), prose(1000), prose(6000) + noise(300)]
    rows = {r.doc_id: r for r in q.quality_rules(make(texts)).collect()}
    assert [rows[i].kept for i in range(10)] == [False] * 6 + [True] * 4


def test_filter_keeps_columns(make):
    texts = cases()
    df = make(texts).selectExpr("*", "1 as ratio", "2 as kept")
    out = q.keep_good(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [i for i, t in enumerate(texts) if brute(t)[6]]


def test_edges(make):
    assert q.quality_rules(make([])).collect() == [] and q.keep_good(make([])).collect() == []
    twice = q.quality_rules(make([cases()[3]] * 2, [8, 8])).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    long = " ".join(f"w{i}" for i in range(300_000))
    assert q.quality_rules(make([long, None], [1, None])).where("doc_id = 1").first().n_words == 300_000
