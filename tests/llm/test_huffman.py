import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sismo.llm import huffman as h

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_lengths(counts):
    """Unlimited Huffman lengths with a heap."""
    q = [(int(c), i, (i,)) for i, c in enumerate(counts) if c]
    length = dict.fromkeys((i for _, i, _ in q), 0)
    heapq.heapify(q)
    tie = len(counts)
    while len(q) > 1:
        a, b = heapq.heappop(q), heapq.heappop(q)
        for i in a[2] + b[2]:
            length[i] += 1
        heapq.heappush(q, (a[0] + b[0], tie, a[2] + b[2]))
        tie += 1
    return length


@pytest.mark.parametrize("most", [20, 8, 5])
def test_code_lengths(most):
    rnd = np.random.default_rng(most)
    counts = (rnd.pareto(0.7, 30) * 5).astype(int)
    length = h.code_lengths(counts, most)
    assert length.max() <= most and (length > 0).tolist() == (counts > 0).tolist()
    assert abs(sum(2.0 ** -int(x) for x in length if x) - 1) < 1e-12
    best = plain_lengths(counts)
    cost = sum(counts[i] * n for i, n in best.items())
    if max(best.values()) <= most:
        assert (counts * length).sum() == cost
    else:
        assert (counts * length).sum() >= cost


def test_few_symbols():
    assert h.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]
    assert h.code_lengths(np.array([0, 0])).tolist() == [0, 0]
    assert h.code_lengths(np.array([3, 0, 3])).tolist() == [1, 0, 1]


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_round_trip_and_independent_blocks(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.geometric(0.01, n), 3000).astype(np.uint32)
    length = h.code_lengths(np.bincount(np.append(ids, [5, 9])), 14)
    payload, at = h.encode_bits(ids, h.canonical(length), length)
    d = h.Decoder(length)
    marks = at[:-1][::h.BLOCK]
    assert d.decode(payload, marks, n).tolist() == ids.tolist()
    for b in range(len(marks)):
        size = min(h.BLOCK, n - b * h.BLOCK)
        assert d.decode(payload, marks[b:b + 1], size).tolist() == ids[b * h.BLOCK:b * h.BLOCK + size].tolist()


def plain(rows, end=2):
    t = Tokenizer.from_file(PATH)
    out, at = [], 0
    for d, x in rows:
        i = t.encode(x or "", add_special_tokens=False).ids + [end]
        out.append((d, at, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        at += len(i)
    return out


def got(df):
    return [tuple(r) for r in df.orderBy("start").collect()]


def test_sample(make, sample):
    rows = list(sample.items())
    random.Random(0).shuffle(rows)
    df = make([t for _, t in rows], [d for d, _ in rows]).repartition(7)
    assert got(h.token_id_files(df, PATH)) == plain(sorted(rows))


def test_edges(make, monkeypatch):
    assert h.token_id_files(make([]), PATH).collect() == []
    monkeypatch.setattr(h, "SEGMENT", 20)
    texts = ["", None, "a b", "a b", " ".join(f"word{i}" for i in range(3000)), "é   x", "<|endoftext|>"]
    df = make(texts).selectExpr("*", "1 as shard", "2 as ids", "3 as kind", "4 as n_tokens")
    assert got(h.token_id_files(df, PATH)) == plain(list(enumerate(texts)))
    assert [r.n_tokens for r in h.token_id_files(make(["a", "a", "b"], [3, 3, None]), PATH).orderBy("start").collect()] == [2, 2, 2]


def test_files_are_in_order(spark, make, tmp_path):
    texts = [f"text number {i}" for i in range(300)]
    h.write_ids(make(texts).repartition(5), PATH, str(tmp_path / "ids"))
    import glob
    import pyarrow.parquet as pq
    seen = []
    for f in sorted(glob.glob(str(tmp_path / "ids/segments/part-*.parquet"))):
        for b in pq.read_table(f).column("doc_ids").to_pylist():
            seen += np.frombuffer(b, "<i8").tolist()
    assert seen == list(range(300))


def test_many_rows_of_one_id(make):
    texts = [f"text {i % 50} " * (i % 7) for i in range(600)]
    ids = [4 if i % 3 else None for i in range(600)]
    rows = h.token_id_files(make(texts + ["first", "last"], ids + [3, 5]).repartition(5), PATH).collect()
    rows.sort(key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in rows] == [None] * 200 + [3] + [4] * 400 + [5]
    t = Tokenizer.from_file(PATH)
    want = [zlib.crc32(np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4").tobytes()) for x in texts]
    assert sorted(r.ids_crc32 for r in rows if r.doc_id == 4) == sorted(w for w, i in zip(want, ids) if i == 4)
