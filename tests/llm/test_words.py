import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from panelmeter.llm import words as W

from .brute import WORD, shingles


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab é\t\n\x0b \u0085", max_size=30)), max_size=8), st.sampled_from([3, 1 << 18]))
def test_words_and_shingles_are_those_of_plain_python(texts, window):
    old, W.WINDOW = W.WINDOW, window
    try:
        row, word, (head, tail) = W.words(pa.array(texts, pa.string()), W.PLAIN, (2, -2))
    finally:
        W.WINDOW = old
    want = [(r, w) for r, t in enumerate(texts) for w in WORD.findall(t or "")]
    assert list(row) == [r for r, _ in want]
    for got, of in ((word, lambda b: b), (head, lambda b: b[:2]), (tail, lambda b: b[-2:])):
        named = {}
        for (_, w), h in zip(want, got):
            assert named.setdefault(of(w.encode()), h) == h
        assert len(set(named.values())) == len(named)
    r, s, _ = W.distinct(*W.shingles(row, word), len(texts))
    assert [int((r == i).sum()) for i in range(len(texts))] == [len(shingles(t)) for t in texts]
    one, two = W.fingerprints(row, word, len(texts))
    runs = [tuple(WORD.findall(t or "")) for t in texts]
    assert len(set(zip(one, two))) == len(set(runs))


def test_batches_cover_all_rows():
    col = pa.array(["a" * n for n in (5, 100, 0, 3, 50)])
    spans = list(W.batches(col, 60))
    assert spans[0][0] == 0 and spans[-1][1] == 5
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert np.all([b > a for a, b in spans])
