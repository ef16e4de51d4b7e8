import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from sismo.llm import pii
from sismo.llm import textarr as ta

TEXTS = ["", None, "mail bob.x@host.com, or bob@host now", "ip 10.2.3.4 not 300.2.3.4 but 1.2.3.4.5 and 010.1.1.1",
         "card 4111 1111 1111 1111 / 4111-1111-1111-1112 / 4111111111111111", "call +1 (377) 555-0271 or +12345 or (377) 555-0271",
         "é@x.y ü a@b.c " * 3, "no data at all", "+1 (269) 555-3296 4524132264652876 end", "4.0 1999 12", "@ @@ a@ @b 5",
         "x " * 30000 + "bob@host.com" + " y" * 30000]


def brute_base(t):
    """The four rules, written out again."""
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
             "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
    out = []
    for n, (k, r) in enumerate(rules.items()):
        for m in re.finditer(r, t or ""):
            d = [int(c) for c in m.group() if c.isdigit()]
            even = [x * 2 - 9 * (x > 4) if i % 2 else x for i, x in enumerate(reversed(d))]
            if (k == "email" or k == "ip" and max(map(int, m.group().split("."))) < 256
                    or k == "card" and len(d) in range(14, 20) and sum(even) % 10 == 0 or k == "phone" and len(d) in range(10, 16)):
                out.append((m.start(), n, k, m.end()))
    return [(k, a, z) for a, _, k, z in sorted(out)]


def test_base_spans(make, sample):
    texts = TEXTS + list(sample.values())
    for r in pii.find_pii(make(texts)).collect():
        b = brute_base(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{z}" for k, a, z in b)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in b) for x in pii.KINDS)
        spans = r.spans.split(",") if r.spans else []
        assert set(line.split(",") if line else []) <= set(spans) and len(spans) == len(b) + r.n_added


def toy(n, chain, skip, rng):
    k = len(pii.KINDS) + 1
    pairs = lambda e: np.array(e, int).reshape(-1, 2).T
    t = pii.Tokens(np.zeros(n, int), np.arange(n), np.arange(n), np.arange(n), rng.normal(size=(n, 3)), pairs(chain), pairs(skip),
                   np.arange(n) == 0, np.arange(n) == n - 1)
    return t, pii.Field(rng.normal(size=(3, k)), rng.normal(size=(k, k)), 1.2)


@pytest.mark.parametrize("chain,skip,exact", [([(0, 1), (1, 2)], [], True), ([(0, 1)], [(1, 2)], True),
                                              ([(0, 1), (1, 2), (2, 3)], [(0, 3)], False), ([], [], True)])
def test_messages_against_enumeration(chain, skip, exact):
    n, k = 4, len(pii.KINDS) + 1
    t, f = toy(n, chain, skip, np.random.default_rng(1))
    p = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        s = sum((t.x @ f.unary)[i, y[i]] for i in range(n)) + f.chain[0, y[0]] + f.chain[y[-1], 0]
        s += sum(f.chain[y[a], y[b]] for a, b in chain) + sum(f.skip * (y[a] == y[b]) for a, b in skip)
        for i in range(n):
            p[i, y[i]] += np.exp(s)
    p /= p.sum(axis=1, keepdims=True)
    assert np.abs(pii.beliefs(t, f) - p).max() < (1e-3 if exact else 0.1)


def test_skips_join_distant_mentions():
    text = "pay 4111-1111-1111-1111 " + "word " * 300 + "so 4111111111111111, or Bob@Host.com " + "word " * 50 + "ann@host.com 12 12"
    buf, off = ta.utf8(pa.array([text]))
    t = pii.active_tokens(buf, off)
    core = [text[a:b] for a, b in zip(t.start, t.end)]
    assert core == ["4111-1111-1111-1111", "4111111111111111", "Bob@Host.com", "ann@host.com", "12", "12"]
    assert sorted(map(tuple, t.skip.T.tolist())) == [(0, 1), (2, 3), (4, 5)]
    assert t.chain.T.tolist() == [[3, 4], [4, 5]]


def test_skip_carries_a_label_to_an_uncertain_mention():
    f = pii.Field(np.zeros((29, 5)), np.zeros((5, 5)), 3.0)
    buf, off = ta.utf8(pa.array(["555-0271 " + "w " * 99 + "x555-0271y 555-0271"]))
    t = pii.active_tokens(buf, off)
    t.x = np.zeros((3, 29), np.float32)
    t.x[0, 0] = 1
    f.unary[0, 4] = 5.0
    p = pii.beliefs(t, f)
    assert p[0, 4] > 0.9 and p[2, 4] > 0.5


def test_training_labels_its_own_kind_of_text():
    rng = np.random.default_rng(0)
    texts = []
    for _ in range(150):
        a, b, c = (int(x) for x in rng.integers(100, 250, 3))
        texts.append(f"word 12 at {a}.{b}.{c}.7 and u{a}@mail{b}.org then +1 ({a}) 555-0{b} or 1999 word 4111111111111111 end")
    f = pii.train(*pii.examples(texts))
    b, o = ta.utf8(pa.array(["reach me +1 (377) 555-0271 4111111111111111 9, x"]))
    (_, text, base, extra), = pii.spans_of(b, o, f)
    assert base == [] and "+1 (377) 555-0271" in [text[a:z] for a, _, z in extra]
    assert pii.train([], []) is None


def test_edges(make):
    assert pii.find_pii(make([])).collect() == []
    clash = make(["a@b.c", "a@b.c", None], [1, 1, None]).selectExpr("*", "1 as spans", "2 as n_email")
    assert sorted((r.doc_id or 0, r.spans) for r in pii.find_pii(clash).collect()) == [(0, ""), (1, "email:0:5"), (1, "email:0:5")]
    out = pii.mask_pii(clash)
    assert out.columns == clash.columns and sorted(str(r.text) for r in out.collect()) == ["<EMAIL>", "<EMAIL>", "None"]


def test_masks():
    assert pii.masked("é a@b.c x 1.2.3.4", [(2, 0, 7), (10, 1, 17)]) == "é <EMAIL> x <IP>"
    assert pii.masked("0123456789", [(1, 3, 5), (1, 2, 4), (3, 1, 7)]) == "0<PHONE>789"
    assert pii.masked("abc", []) == "abc"


def test_patterns_on_random_texts():
    import random
    rnd = random.Random(21)
    for _ in range(4000):
        t = "".join(rnd.choices(["a", "b.c", "@", "@", ".", "-", "_", "1", "23", "4", " ", "+", "(", ")", "é", "1.2.3.4", "00300", "a@b.c"], k=rnd.randrange(0, 30)))
        assert [(k, a, z) for a, k, z in pii.base_spans(t)] == [(pii.KINDS.index(k), a, z) for k, a, z in brute_base(t)], t


def test_patterns_take_linear_time():
    import time
    n = 1_000_000
    t0 = time.time()
    for t in ("7" * n, "0" * n + ".1.1.1", "a" * n + " x@y", "a@" * (n // 2), "@" + "a.b" * (n // 3), "+1" * (n // 2), "+1" + "." * n, "1." * (n // 2),
              "a" * n + "@b", "1 " * (n // 2), "_a@b.c" * (n // 6)):
        pii.base_spans(t)
    assert time.time() - t0 < 12


def test_rare_kinds_train_wherever_they_stand(make):
    import random
    rnd = random.Random(2)
    plain = [f"note {i} of {rnd.randrange(10 ** 6)} and more" for i in range(3000)]
    long = "word " * 9000 + "mail ann@host.example.com now" + " word" * 9000
    docs = make(plain + [long] + ["ring +1 (212) 555-0199 soon"] * 3).repartition(5)
    seen = []
    old = pii.train
    pii.train = lambda tokens, labels: seen.append(labels)
    try:
        pii.fit(docs)
    finally:
        pii.train = old
    kinds = np.bincount(np.concatenate(seen[0]) + 1, minlength=6)
    assert kinds[2] == 1 and kinds[5] >= 1 and sum(len(x) for x in seen[0]) < 3 * pii.TRAIN_DOCS * 2
