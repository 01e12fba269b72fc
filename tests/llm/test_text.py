"""Word and n-gram hashing against regular expressions."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import helpers as H
from pondus.llm import _text as T

ALPHABET = st.text(alphabet="aB9 \t\n\x0b\x00.,-éß 　Ω😀", max_size=60)


@pytest.mark.parametrize("cls,ref", [(T.NON_SPACE, H.words), (T.ALNUM, H.alnum_words)])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), ALPHABET), min_size=1, max_size=8), size=st.sampled_from([1, 40, 1 << 20]), piece=st.sampled_from([5, 16, 1 << 18]))
def test_words_agree_with_a_regular_expression(cls, ref, texts, size, piece):
    old, T.PIECE = T.PIECE, piece
    try:
        seen = {}
        for s in T.slices(pa.array(texts, pa.string()), size):
            w = T.words(s, cls)
            for r in range(len(s.offsets) - 1):
                a, b = w.bounds[r], w.bounds[r + 1]
                got = [bytes(T.LOWER[s.data[x:y]]).decode() for x, y in zip(w.start[a:b], w.end[a:b])]
                assert got == ref(texts[s.first + r])
                for word, h in zip(got, w.hash[a:b]):
                    assert seen.setdefault(word, int(h)) == int(h)
        assert len(set(seen.values())) == len(seen)
    finally:
        T.PIECE = old


def test_ngrams_and_sets():
    (s,) = T.slices(pa.array(["a b c d e f", "a b c d e", "x y", "", "b c d e f", "x  Y "]))
    rows, hashes = T.ngrams(T.words(s, T.NON_SPACE), 5)
    values, bounds = T.sets(rows, hashes, 6)
    sets = [set(values[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    assert [len(x) for x in sets] == [2, 1, 1, 0, 1, 1]
    assert sets[0] == sets[1] | sets[4]
    assert sets[2] == sets[5]


def test_a_word_longer_than_a_piece():
    text = "a" * 700_000 + " b " + "é" * 300_000
    (s,) = T.slices(pa.array([text]))
    w = T.words(s, T.NON_SPACE)
    assert (w.end - w.start).tolist() == [700_000, 1, 600_000]
    assert len(np.unique(w.hash)) == 3
