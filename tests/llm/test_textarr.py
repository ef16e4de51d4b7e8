import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from sismo.llm import textarr as ta

TEXT = st.lists(st.text(st.sampled_from("ab é\n\t日\x0b."), max_size=40), max_size=8)


@given(TEXT)
def test_words(texts):
    buf, off = ta.utf8(pa.array(texts, pa.string()))
    w = ta.words(buf, off)
    raw = buf.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(w.start[w.first[d]:w.first[d + 1]], w.end[w.first[d]:w.first[d + 1]])] for d in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    flat = [x for d in got for x in d]
    seen = {}
    for x, h in zip(flat, w.hash.tolist()):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


@given(TEXT, st.integers(1, 4))
def test_windows(texts, size):
    buf, off = ta.utf8(pa.array(texts, pa.string()))
    w = ta.words(buf, off)
    start, group = ta.windows(w.first, size)
    want = [(d, w.first[d] + i) for d in range(len(texts)) for i in range(int(w.first[d + 1] - w.first[d]) - size + 1)]
    assert list(zip(group.tolist(), start.tolist())) == [(d, int(i)) for d, i in want]


@given(TEXT)
def test_code_points(texts):
    buf, off = ta.utf8(pa.array(texts, pa.string()))
    assert np.diff(ta.code_points(buf)[off]).tolist() == [len(t) for t in texts]


def test_arrow_forms():
    for t in (pa.string(), pa.large_string()):
        a = pa.array(["x", None, "é y"], t)
        for col in (a, pa.chunked_array([a, a]), a.slice(1)):
            buf, off = ta.utf8(col)
            parts = [buf[i:j].tobytes().decode() for i, j in zip(off[:-1], off[1:])]
            assert parts == [x or "" for x in col.to_pylist()]
    buf, off = ta.utf8(pa.array([], pa.string()))
    assert len(buf) == 0 and off.tolist() == [0] and ta.words(buf, off).first.tolist() == [0]


def test_long_text_goes_in_blocks():
    text = "word " * (ta.BLOCK // 2) + "x" * (3 * ta.BLOCK) + " word"
    buf, off = ta.utf8(pa.array([text]))
    w = ta.words(buf, off)
    assert len(w.hash) == ta.BLOCK // 2 + 2 and w.hash[0] == w.hash[-1] == w.hash[-3] != w.hash[-2]


def test_slices_are_whole_documents():
    off = np.array([0, 3, 3, 20, 21, 40])
    assert list(ta.slices(off, 10)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(ta.slices(np.array([0]), 10)) == []
