"""The pipeline from end to end on a planted corpus, against plain versions of its stages."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from kpiloom.llm import langid, sentence_pieces
from tests.llm import brute
from tests.llm.test_operators import frame

pytestmark = pytest.mark.usefixtures("light")

# Invented words of three invented languages, told apart by their letters.
SOUNDS = {"aa": ("ka", "lo", "mi", "tu", "sa"), "bb": ("ström", "ngeß", "wüch", "tzä"), "cc": ("éau", "çon", "quê", "ller")}


def prose(lang, n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(SOUNDS[lang], rng.integers(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    langs = sorted(SOUNDS)
    docs = [(i, prose(langs[i % 3], 80 + i % 40, i), langs[i % 3]) for i in range(150)]
    passage, leak = prose("aa", 60, 900), prose("bb", 20, 901)
    docs += [
        (200, docs[7][1], "bb"),  # an exact copy
        (201, docs[9][1].upper(), "aa"),  # one that only differs in case
        (202, docs[9][1] + " " + docs[9][1].split()[0], "aa"),  # a near copy
        (203, f"{prose('aa', 90, 910)} {passage}\n{prose('aa', 50, 911)}", "aa"),
        (204, f"{prose('aa', 70, 912)}  {passage} {prose('aa', 90, 913)}", "aa"),  # the passage goes from here
        (205, f"{prose('bb', 90, 914)} {leak} {prose('bb', 40, 915)}", "bb"),  # holds a benchmark item
        (206, None, "aa"),
        (207, "", "bb"),
        (208, "1234 -- !! 99", None),
        (209, prose("cc", 3000, 916), None),
    ]
    rng = np.random.default_rng(1)
    order = rng.permutation(len(docs)).tolist()
    items = [(1, leak), (2, prose("cc", 15, 999)), (3, None)]
    return [docs[i] for i in order], items


def test_the_whole_pipeline(spark, corpus, tmp_path):
    docs, items = corpus
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in docs]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    frame(spark, rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    # Every text of one of the languages stays, and nothing without a letter does.
    left = [(i, t) for i, t, _ in docs if i not in (206, 207, 208)]
    groups = {d: least for d, _, least in brute.groups(left)}
    left = [(i, t) for i, t in left if groups[i] == i]
    assert 200 not in dict(left) and 201 not in dict(left)
    cut = brute.without_repeats(left)
    texts = {}
    for (i, t), (_, n, gone, digest) in zip(left, cut, strict=True):
        texts[i] = (t, n, gone, digest)
    assert texts[204][2] == 60 and sum(v[2] for v in texts.values()) == 60
    own = dict(left)[204].split()
    kept = " ".join(own[:70] + own[130:])
    assert hashlib.sha256(kept.encode()).hexdigest() == texts[204][3]
    left = [(i, kept if i == 204 else t) for i, t in left]
    dirty = {r[0] for r in brute.contaminated(left, items) if r[-1]}
    assert dirty == {205}
    left = [(i, t) for i, t in left if i not in dirty]

    assert sorted(found) == sorted(i for i, _ in left)
    encoder = sentence_pieces.Encoder(sentence_pieces.vocabulary(sentence_pieces.VOCABULARY))
    for (i, t), ways in zip(left, encoder.encode(pa.array([t for _, t in left]), 2), strict=True):
        assert found[i]["ids_sha256"] == hashlib.sha256(ways[0][1].tobytes()).hexdigest() and found[i]["round_trip"]
        assert found[i]["n_pieces"] == len(ways[0][1]) and found[i]["margin"] == pytest.approx(ways[0][0] - ways[1][0], abs=2e-3)


def test_language_stage_follows_the_prediction(spark, corpus, monkeypatch):
    """What no language holds half of goes, whatever letters it has."""
    docs, _ = corpus
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in docs]
    table = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    told = langid.predict(table, langid.train(table, corpus_pipeline.F.lit(True)), ["doc_id"])
    scores = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in told.collect()}
    edge = float(np.median([s for name, s in scores.values() if name != langid.UNKNOWN]))
    monkeypatch.setattr(langid, "train", lambda documents, usable, train=langid.train: train(documents, corpus_pipeline.F.lit(True)))
    monkeypatch.setattr(corpus_pipeline, "LEAST_SHARE", edge)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, table, "").collect()}
    assert kept == {i for i, (name, s) in scores.items() if name != langid.UNKNOWN and s >= edge}
    assert 60 < len(kept) < 110


def test_the_language_sample_does_not_follow_the_splits(spark, corpus, monkeypatch):
    docs, _ = corpus
    rows = [(i, t, lang) for i, t, lang in docs]
    table = frame(spark, rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid.ByteTagger, "fit", lambda self, windows, labels: seen.append((self.languages, windows, labels)))
    for parts in (1, 6):
        langid.train(table.repartition(parts), corpus_pipeline.F.lit(True), per_language=20)
    assert all(np.array_equal(a, b) for a, b in zip(*seen, strict=True))
    langid.train(table, corpus_pipeline.F.lit(True), per_language=20, most_languages=2)
    assert len(seen[2][0]) == 2 and len(seen[2][1]) == 40
