"""Word hashes, and the forward pass and sample of the toxicity classifier."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest

from kpiloom.llm import toxicity
from kpiloom.llm.flat import LONG, span_hashes, words_of
from tests.llm.test_operators import frame, text


def hashes(texts, lower=False):
    words = words_of(pa.array(texts), lower)
    raw = [words.data[s:e].tobytes() for s, e in zip(words.start, words.end, strict=True)]
    return raw, span_hashes(words.data, words.start, words.end)


def test_equal_words_and_only_those_hash_alike():
    rng = np.random.default_rng(3)
    pool = ["".join(rng.choice(list("abé日\0"), n)) for n in [*range(1, 40), LONG - 1, LONG, LONG + 1, 3000] for _ in range(8)]
    texts = [" ".join(rng.choice(pool, 60)) + rng.choice(["", " a", " ab"]) for _ in range(80)] + ["a", "", None, "x" * 7, "x" * 8]
    raw, found = hashes(texts)
    assert len(raw) > 4000
    by_word = {}
    for word, h in zip(raw, found.tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word) > 250
    alone = hashes([raw[5].decode()])[1]  # wherever it stands, also where the data ends
    assert alone[0] == found[5]


@pytest.mark.parametrize("length", [16, 64, 256, 1024, 4096])
def test_words_that_differ_by_a_pattern_do_not_collide(length):
    """The words that any polynomial modulo a power of two maps to one value."""
    bits = np.array([bin(i).count("1") & 1 for i in range(length)])
    one = "".join("ab"[b] for b in bits)
    other = "".join("ba"[b] for b in bits)
    _, found = hashes([f"{one} {other}"])
    assert found[0] != found[1]


def test_hashes_take_memory_by_words():
    import tracemalloc

    data = np.full(32 << 20, 97, np.uint8)
    start = np.arange(0, len(data), 1 << 20)
    tracemalloc.start()
    span_hashes(data, start, start + (1 << 20) - 1)
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()


def plain_score(model, text_):
    """The network as its definition reads: embeddings of words, every filter at every place, the largest, one layer."""
    word, stem, _ = toxicity.buckets(pa.array([text_]))
    embedded = model.word[word].astype(float) + model.stem[stem]
    n, hidden = len(word), []
    for filters in model.filters:
        # A filter may begin at each word, and at the first place behind the last one.
        places = range(n - toxicity.WIDTHS[-1] + 1)
        answers = [
            [sum(embedded[i + k] @ filters[k][:, f] for k in range(len(filters))) for f in range(filters.shape[2])] for i in places
        ]
        hidden += np.max(answers, axis=0).tolist()
    logit = sum(max(h + b, 0) * o for h, b, o in zip(hidden, model.bias, model.out, strict=True)) + model.shift[0]
    return 1 / (1 + np.exp(-logit))


def test_forward_pass_equals_its_definition():
    model = toxicity.WordFilters(seed=8)
    rng = np.random.default_rng(2)
    model.bias += rng.normal(0, 0.1, len(model.bias)).astype(np.float32)
    model.word *= 30
    model.stem *= 30
    texts = [text(n, n) for n in (1, 2, 3, 5, 40)] + ["", None, "Same same SAME"]
    found = model.scores(pa.array(texts))
    assert np.allclose(found, [plain_score(model, t) for t in texts], atol=1e-4)
    # Long inputs are worked off in blocks, whatever their number.
    word, stem, begin = toxicity.buckets(pa.array(texts))
    assert np.allclose(model.pooled(word, stem, begin, block=8), model.pooled(word, stem, begin), atol=1e-6)


def test_the_sample_follows_key_and_text(spark, light, monkeypatch):
    """Not the splits: the same rows in other partitions give the same model; long texts give a window."""
    rows = [(i, text(20 + i % 7, i) + (" moron" if i % 3 == 0 else " fine"), "en", int(i % 3 == 0)) for i in range(150)]
    rows.append((500, text(5000, 77), "de", 0))
    labelled = frame(spark, rows, "doc_id long, text string, lang string, toxic int")
    seen = []
    monkeypatch.setattr(
        toxicity.WordFilters, "fit", lambda self, sample, labels, weights: seen.append((sample, labels, weights))
    )
    for parts in (1, 5):
        known = labelled.select("doc_id", "toxic").union(labelled.select("doc_id", "toxic").limit(20))
        toxicity.train(labelled.drop("toxic").repartition(parts), known, per_class=40, most_chars=400)
    for one, other in zip((*seen[0][0], *seen[0][1:]), (*seen[1][0], *seen[1][1:]), strict=True):
        assert np.array_equal(one, other)
    sizes = np.diff(np.append(seen[0][0][2], len(seen[0][0][0])))
    assert 30 < len(sizes) < 160 and sizes.max() <= 200 + toxicity.WIDTHS[-1]
    assert toxicity.train(labelled.drop("toxic"), labelled.where("toxic = 1").select("doc_id", "toxic")) is None


def test_all_labelled_rows_are_learned_from_and_whole(spark, light, monkeypatch):
    """Words at both ends of texts of 30,000 characters are counted in each row that is not kept back."""
    rows = [(i, "zebra " + ("w" * 300 + " ") * 100 + ("moron" if i % 2 else "fine"), "en", i % 2) for i in range(40)]
    labelled = frame(spark, rows, "doc_id long, text string, lang string, toxic int")
    seen, lean = [], toxicity._lean
    monkeypatch.setattr(toxicity, "_lean", lambda *counts: (seen.append(counts), lean(*counts))[1])
    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    model, thresholds = toxicity.train(labelled.drop("toxic").repartition(3), labelled.select("doc_id", "toxic"))
    n, ones, mean = seen[0]
    zebra, moron, fine = (toxicity.buckets(pa.array([word]))[0][0] for word in ("zebra", "moron", "fine"))
    assert 20 < n[zebra] < 40 and n[moron] + n[fine] == n[zebra]
    assert ones[moron] == n[moron] > 0 and ones[fine] == 0 and ones[zebra] == n[moron] == round(mean * n[zebra])
    assert (model.word[toxicity.PAD] == 0).all() and set(thresholds) <= {"en"}


def cpu_seconds(work, times=5):
    took = []
    for _ in range(times):
        begin = time.process_time()
        work()
        took.append(time.process_time() - begin)
    return min(took)


def plain_places(model, word, stem, begin):
    """For each width the place (text, filter) of the first largest answer, found along the texts."""
    embedded, found = model.word[word] + model.stem[stem], []
    ends = np.append(begin[1:], len(word))
    for filters in model.filters:
        answers = embedded @ filters[0]
        for k in range(1, len(filters)):
            answers[: len(word) - k] += embedded[k:] @ filters[k]
        for k in range(1, toxicity.WIDTHS[-1]):
            answers[ends - k] = -np.inf
        top = np.repeat(np.maximum.reduceat(answers, begin, axis=0), ends - begin, axis=0)
        place = np.where(answers == top, np.arange(len(word))[:, None], len(word))
        found.append(np.minimum.reduceat(place, begin, axis=0))
    return found


def test_a_step_moves_what_the_largest_answers_ask_for():
    model = toxicity.WordFilters(seed=4)
    model.word *= 30
    texts = ["same same same same", "", "a b a b a b c", *(text(n, n) for n in (1, 2, 30))]
    word, stem, begin = toxicity.buckets(pa.array(texts))
    labels, weights = np.array([1, 0, 1, 0, 1, 0], np.float32), np.linspace(0.5, 2, 6).astype(np.float32)
    before = [p.astype(float) for p in model.params]
    places, rate = plain_places(model, word, stem, begin), 0.1
    wanted = [np.zeros_like(p) for p in before]
    embedded, size = before[0][word] + before[1][stem], toxicity.FILTERS
    for t in range(len(texts)):
        hidden = before[5].copy()
        for w, place in enumerate(places):
            for f, at in enumerate(place[t].tolist()):
                hidden[w * size + f] += sum(embedded[at + k] @ before[2 + w][k, :, f] for k in range(w + 1))
        g = (1 / (1 + np.exp(-(np.maximum(hidden, 0) @ before[6] + before[7][0]))) - labels[t]) * weights[t] / len(texts)
        own = g * before[6] * (hidden > 0)
        wanted[5] += own
        wanted[6] += g * np.maximum(hidden, 0)
        wanted[7] += g
        for w, place in enumerate(places):
            for f, at in enumerate(place[t].tolist()):
                for k in range(w + 1):
                    wanted[2 + w][k, :, f] += own[w * size + f] * embedded[at + k]
                    for table, bucket in ((0, word[at + k]), (1, stem[at + k])):
                        if bucket != toxicity.PAD:
                            wanted[table][bucket] += own[w * size + f] * before[2 + w][k, :, f]
    seen = [np.full(p.shape, 1e-2, np.float32) for p in model.params]
    model._step(word, stem, begin, labels, weights, model.params, seen, rate)
    for old, new, grad in zip(before, model.params, wanted, strict=True):
        assert np.allclose(new, old - rate * grad / np.sqrt(grad * grad + 1e-2), atol=1e-4)


def test_a_step_costs_less_than_the_search_along_the_texts():
    """CPU time, which the check bounds: the plain search alone took most of a step."""
    rng = np.random.default_rng(6)
    begin = np.arange(64) * 500
    word, stem = (rng.integers(1, n, 64 * 500).astype(np.int32) for n in (toxicity.WORD_BUCKETS, toxicity.STEM_BUCKETS))
    model, labels = toxicity.WordFilters(), (np.arange(64) % 2).astype(np.float32)
    seen = [np.full(p.shape, 1e-2, np.float32) for p in model.params]
    step = cpu_seconds(lambda: model._step(word, stem, begin, labels, np.ones(64, np.float32), model.params, seen, 0.01))
    assert step < 0.75 * cpu_seconds(lambda: plain_places(model, word, stem, begin))


def test_texts_of_each_bucket_are_counted_once_and_fast():
    rng = np.random.default_rng(7)
    for texts, places in ((2000, 400_000), (40_000, 90_000)):  # the larger product of texts and buckets takes 64 bits
        owner = np.sort(rng.integers(0, texts, places))
        bucket = rng.zipf(1.3, places).astype(np.int64) % toxicity.WORD_BUCKETS
        bucket, labels = bucket.astype(np.int32), rng.integers(0, 2, texts).astype(np.float32)
        n, ones = toxicity._bucket_texts(bucket, owner, labels, toxicity.WORD_BUCKETS)
        pairs = set(zip(owner.tolist(), bucket.tolist(), strict=True))
        for count, some in ((n, pairs), (ones, [(t, b) for t, b in pairs if labels[t]])):
            assert np.array_equal(count, np.bincount([b for _, b in some], minlength=toxicity.WORD_BUCKETS))
    owner, bucket = np.repeat(np.arange(2000), 500), rng.integers(0, toxicity.WORD_BUCKETS, 1_000_000).astype(np.int32)
    labels = np.ones(2000, np.float32)
    fast = cpu_seconds(lambda: toxicity._bucket_texts(bucket, owner, labels, toxicity.WORD_BUCKETS), 3)
    assert fast < 0.5 * cpu_seconds(lambda: np.unique(owner * np.int64(toxicity.WORD_BUCKETS) + bucket), 3)
