import random
import re

import numpy as np
import pytest

from sismo.llm.sentence_spans import CLOSERS, FULL_STOPS, MIN_WORDS, STOPS, dedup_sentence_spans, ends_sentence

WS = " \t\n\r\v\f"


def split(t):
    """Sentences as lists of (start, end, word)."""
    words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
    out, last = [], None
    for w in words:
        if last is None or last[2][-1] in ".!?" or "\n" in t[last[1]:w[0]]:
            out.append([])
        out[-1].append(w)
        last = w
    return out


def runs(s, least):
    n, out = len(s), set()
    size = [len(x) for x in s]
    for i in range(n):
        if size[i] >= 2 * least:
            out.add((i, i + 1))
            continue
        for j in range(i + 2, n + 1):
            if sum(size[i:j]) >= least:
                out.add((i, j))
                break
        for k in range(i - 1, -1, -1):
            if sum(size[k:i + 1]) >= least:
                out.add((k, i + 1))
                break
    return out


def brute(rows, least=MIN_WORDS):
    first, all_runs = {}, []
    for d, t in rows:
        s = split(t or "")
        for a, b in runs(s, least):
            key = tuple(w[2] for x in s[a:b] for w in x)
            all_runs.append((key, d, a, b))
            if d is not None:
                first[key] = min(first.get(key, (d, a)), (d, a))
    out = []
    for d, t in rows:
        s = split(t or "")
        drop = set()
        for key, e, a, b in all_runs:
            if e == d and d is not None and first[key] != (d, a):
                drop.update(range(a, b))
        keep, text = [], t
        if drop:
            chars = [True] * len(t)
            for i in drop:
                start = s[i - 1][-1][1] if i else 0
                for c in range(start, s[i][-1][1]):
                    chars[c] = False
            text = "".join(c for c, k in zip(t, chars) if k)
            if 0 in drop:
                text = text.lstrip(WS)
        out.append((d, text, len(s), len(drop)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in df.collect()), key=repr)


def test_matches_brute_force(make):
    rnd = random.Random(1)
    vocab = [f"é{i}" for i in range(300)]

    def sent(lo=1, hi=14):
        return " ".join(rnd.choices(vocab, k=rnd.randrange(lo, hi))) + rnd.choice([".", "!", "?", ",", "."])
    passages = [" ".join(sent() for _ in range(9)) for _ in range(4)] + [" ".join(rnd.choices(vocab, k=60))]
    texts = []
    for _ in range(60):
        parts = [sent() for _ in range(rnd.randrange(0, 9))]
        for _ in range(rnd.randrange(0, 3)):
            parts.insert(rnd.randrange(len(parts) + 1), "\n" + rnd.choice(passages) + "\n")
        texts.append(rnd.choice([" ", "\n", "  "]).join(parts))
    texts += [texts[0], "", None, "x", passages[0], passages[0] + "\n" + passages[0]]
    rows = list(enumerate(texts))
    assert got(dedup_sentence_spans(make(texts))) == brute(rows)


def test_sample_matches_brute_force(make, sample):
    rows = list(sample.items())
    assert got(dedup_sentence_spans(make([t for _, t in rows], [i for i, _ in rows]))) == brute(rows)


def test_edges(make):
    assert dedup_sentence_spans(make([])).collect() == []
    p = " ".join(f"a{i} b{i} c{i} d{i} e{i} f{i}." for i in range(12))
    repeated = got(dedup_sentence_spans(make([p, p, "new. " + p, p], [1, 1, 2, None])))
    assert repeated == sorted([(1, p, 12, 0), (1, p, 12, 0), (2, "new.", 13, 12), (None, p, 12, 0)], key=repr)
    clash = make([p, p]).selectExpr("*", "1 as text_key", "2 as hash", "3 as cuts", "4 as first")
    assert [r.n_removed for r in dedup_sentence_spans(clash).orderBy("doc_id").collect()] == [0, 12]
    long = " ".join(f"w{i}" for i in range(30000)) + ". " + p
    assert got(dedup_sentence_spans(make([long, p])))[1][3] == 12


@pytest.mark.parametrize("end", ['."', "!)", "?'", ".)]", ".\u201d", "!\u00bb", "\u3002", "\uff1f\u300d", "\u2026\"", "\u0964", "." + ")" * 20])
def test_stops_before_closing_marks_and_other_stops(make, end):
    first, second = (" ".join(f"{k}{i}" for i in range(30)) for k in "ab")
    shared = f"{first}{end} {second}{end}"
    texts = [f"one he said{end} {shared} Then this went on", f"two they asked{end} {shared} Now that came up"]
    assert got(dedup_sentence_spans(make(texts))) == [(0, texts[0], 4, 0), (1, f"two they asked{end} Now that came up", 4, 2)]


def test_word_ends(make):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("a\u00e9\u732b\U0001f600," + STOPS + FULL_STOPS[:4] + CLOSERS, k=rnd.randrange(1, 30))) for _ in range(3000)]
    words += ["x" + s + c for s in STOPS + FULL_STOPS for c in ["", *CLOSERS]] + list(CLOSERS)
    raw = [w.encode() for w in words]
    end = np.cumsum([len(r) for r in raw])
    want = [w.rstrip(CLOSERS)[-1:] in tuple(STOPS + FULL_STOPS) for w in words]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    assert ends_sentence(buf, end - [len(r) for r in raw], end).tolist() == want
