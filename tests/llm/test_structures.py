"""Succinct structures and flat words against plain Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kpiloom.llm import elias_fano
from kpiloom.llm.elias_fano import EliasFano
from kpiloom.llm.flat import gram_hashes, span_hashes, words_of
from kpiloom.llm.fm_index import FMIndex, WaveletMatrix, least_in
from kpiloom.llm.substring import anchors_of


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300), st.lists(st.integers(0, 5001), min_size=1, max_size=50))
def test_elias_fano(values, asked):
    values = np.sort(np.array(values, np.uint64))
    sequence = EliasFano(values, 5002)
    assert (sequence.get(np.arange(len(values))) == values).all()
    asked = np.array(asked, np.uint64)
    assert (sequence.successor(asked) == np.searchsorted(values, asked)).all()
    found = sequence.find(asked)
    assert all((f >= 0) == (a in values) and (f < 0 or values[f] == a) for f, a in zip(found, asked, strict=True))


def test_elias_fano_in_runs(monkeypatch):
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64) << np.uint64(1))
    asked = np.sort(np.concatenate([values, values + np.uint64(1), values[:40]]))
    place = np.searchsorted(values, asked)
    there = asked % np.uint64(2) == 0
    monkeypatch.setattr(elias_fano, "RUN", 7)
    sequence = EliasFano(values, 1 << 64)
    assert (sequence.get(np.arange(len(values))) == values).all()
    assert (sequence.find(asked) == np.where(there, place, -1)).all()
    first, last = np.maximum(place - 3, 0), np.minimum(place + 2, len(values))
    assert (sequence.find(asked, first, last) == np.where(there, place, -1)).all()
    assert (sequence.find(asked, first, np.minimum(place, last)) == -1).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=200))
def test_wavelet_matrix_counts(values):
    values = np.array(values)
    matrix = WaveletMatrix(values, 10)
    for symbol in range(10):
        at = np.arange(len(values) + 1)
        counts = matrix.follow(np.full(len(at), symbol), at) - matrix.follow(np.array([symbol]), np.array([0]))
        assert (counts == np.concatenate([[0], np.cumsum(values == symbol)])).all()


@pytest.mark.parametrize("length", [2, 5, 50])
def test_windows_of_passages(length):
    rng = np.random.default_rng(length)
    passages = [rng.integers(1, 3, rng.integers(1, 80)) for _ in range(30)]
    passages += [passages[3], np.ones(70, np.int64)]
    text = np.concatenate([np.append(p, 0) for p in passages])
    owner = np.repeat(np.arange(len(passages)), [len(p) + 1 for p in passages])
    index = FMIndex(text, 3, length)
    sizes = np.array([len(p) for p in passages])
    aligned = np.zeros((len(passages), sizes.max()), np.int64)
    for i, p in enumerate(passages):
        aligned[i, sizes.max() - len(p) :] = p
    least = least_in(index.windows(aligned, sizes), owner[index.order], 99)[:, ::-1]
    for i, p in enumerate(passages):
        for s in range(len(p) - length + 1):
            key = tuple(p[s : s + length])
            first = next(j for j, q in enumerate(passages) if any(tuple(q[t : t + length]) == key for t in range(len(q) - length + 1)))
            assert least[i, least.shape[1] - (len(p) - length + 1) + s] == first


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té日A", max_size=20)), max_size=8))
def test_words(texts):
    words = words_of(pa.array(texts, pa.string()), lower=True)
    raw = words.data.tobytes()
    found = [raw[a:b] for a, b in zip(words.start, words.end, strict=True)]
    assert found == [w for t in texts for w in (t or "").encode().lower().split()]
    assert words.count.tolist() == [len((t or "").encode().split()) for t in texts]
    hashes = span_hashes(words.data, words.start, words.end)
    assert len(set(hashes.tolist())) == len(set(found))


def test_every_window_of_equal_words_shares_an_anchor():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 4, 300).astype(np.uint64)
    left, right = (np.concatenate([rng.integers(9, 99, 70).astype(np.uint64), common, rng.integers(9, 99, 70).astype(np.uint64)]) for _ in range(2))
    places = [dict(zip(*anchors_of(t, np.array([len(t)])), strict=True)) for t in (left, right)]
    for s in range(70, 70 + 300 - 49):
        inside = [{h for p, h in found.items() if s <= p <= s + 40} for found in places]
        assert inside[0] & inside[1]
    constant = np.zeros(5000, np.uint64)
    kept, _ = anchors_of(constant, np.array([5000]))
    assert len(kept) < 200 and np.diff(kept).max() <= 41 and kept[0] == 0
    assert len(gram_hashes(constant, 10)) == 4991
