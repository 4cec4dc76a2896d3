"""Texts are told apart for the tokenizer, and ids are counted, without dear steps; with the same results."""

import numpy as np

from loomframe.llm import rans, wordbpe


def test_unusual_texts_without_the_pattern(monkeypatch):
    plain = ["", "a b", "café ÿ", "\x1b", "a<b|c", "\x00\x7f\x85\xa0"]
    texts = [*plain, "x<|y", *[f"q{c}" for c in "\x1c\x1d\x1e\x1f\x20"], "Ā", "˿", "̀", "œ<|", "\ud800", "\U0001f600", "ā\x1f"]
    assert [wordbpe.unusual(t) for t in texts] == [wordbpe.UNUSUAL.search(t) is not None for t in texts]
    monkeypatch.setattr(wordbpe, "UNUSUAL", None)
    assert not any(map(wordbpe.unusual, plain))


def test_counted_frequencies():
    for ids in ([7, 7, 3, 0, 7], [5, 1 << 31, 5]):
        symbols, freqs = rans.frequencies(np.array(ids, np.uint32))
        assert symbols.tolist() == sorted(set(ids)) and int(freqs.sum()) == 1 << rans.PRECISION and symbols.dtype == freqs.dtype == np.uint32
