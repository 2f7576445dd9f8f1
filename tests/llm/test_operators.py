"""Each operator against a plain version, on rows with everything that may go wrong in them."""

from __future__ import annotations

import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kpiloom.llm import (
    common,
    html_extract,
    langid,
    ngram_lm,
    queries,
    sentence_pieces,
    simhash,
    substring,
    token_counts,
    topk,
    toxicity,
    winnowing,
)
from kpiloom.session import DROP_SHUFFLES
from tests.llm import brute

pytestmark = pytest.mark.usefixtures("light")

RNG = np.random.default_rng(1)
WORDS = [f"w{i}" for i in range(40)] + ["Été", "straße", "日本", "x-1"]


def text(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


PASSAGE = text(70, 5)
ITEMS = [(1, text(14, 9)), (2, "Short item here"), (3, None), (4, ""), (None, text(12, 10)), (5, text(14, 9))]
DOCS = [
    (1, text(200, 1)),
    (2, text(200, 1)),  # a copy
    (3, text(200, 1).replace("w7", "w8", 1)),  # a near copy
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, text(60, 2) + " " + PASSAGE + "\n" + text(60, 3)),
    (8, PASSAGE.replace(" ", "  ") + " tail " + text(14, 9)),
    (9, "Any SHORT,item: here!"),
    (9, "Any SHORT,item: here!"),  # a repeated row
    (10, "same " * 300),
    (11, "same " * 300 + "other"),
    (12, text(12, 10).upper() + " " + text(3000, 4)),
    (None, text(200, 1)),
    (13, "|| -- 12 !!"),
]
# Columns that operators use as names of their own.
CLASHING = "1 as _row, 'x' as words, 2L as hash, 3 as batch, 4 as anchor, 'y' as held_out, 'z' as _text, 0 as score"


def frame(spark, rows, kinds):
    common.prepare(spark)
    return spark.createDataFrame(rows, kinds).selectExpr("*", *CLASHING.split(", ")).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, [(*d, "en" if i % 2 else "de") for i, d in enumerate(DOCS)], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def stored(docs, tmp_path_factory):
    """For operators that read their input more than once."""
    folder = str(tmp_path_factory.mktemp("docs")) + "/d"
    docs.write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def bag(df, *columns):
    return sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))


def test_decontamination(spark, stored):
    items = frame(spark, ITEMS, "item_id long, text string")
    found = winnowing.contaminated_words(stored, items)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = brute.contaminated(DOCS, ITEMS)
    assert bag(found, *columns) == sorted(map(str, expected))
    assert sum(r[-1] for r in expected) >= 3
    assert winnowing.contaminated_words(stored.limit(0), items).isEmpty()
    assert winnowing.contaminated_words(stored, items.limit(0)).where("contaminated or n_items > 0").isEmpty()


@pytest.fixture
def resplit(spark, stored, monkeypatch):
    """Makes files be read in other splits from the time a function of a module has been called."""
    before = spark.conf.get("spark.sql.files.openCostInBytes")

    def after(module, name):
        function = getattr(module, name)

        def run(*args, **kwargs):
            out = function(*args, **kwargs)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            spark.conf.set("spark.sql.files.minPartitionNum", "1")
            return out

        monkeypatch.setattr(module, name, run)

    yield after
    spark.conf.set("spark.sql.files.openCostInBytes", before)
    spark.conf.unset("spark.sql.files.minPartitionNum")


def test_decontamination_with_other_splits(spark, stored, resplit):
    resplit(winnowing, "_with_hits")
    found = winnowing.contaminated_words(stored, frame(spark, ITEMS, "item_id long, text string"))
    expected = [r[:3] for r in brute.contaminated(DOCS, ITEMS)]
    assert bag(found, "doc_id", "n_words", "n_hit") == sorted(map(str, expected))


def test_near_dedup_with_other_splits(spark, stored, resplit):
    whole = stored.selectExpr("doc_id", "text", "lang", "'s' as source", "1L as n_chars")
    expected = bag(corpus_pipeline.near_dedup(spark, whole, ""), "doc_id", "text")
    resplit(simhash, "near_duplicates")
    assert bag(corpus_pipeline.near_dedup(spark, whole, ""), "doc_id", "text") == expected
    assert {"4", "5", "6"} & {s[1:-1].split(",")[0] for s in expected} == {"4"}


def test_near_dedup_keeps_one_of_each_component(spark):
    rows = [(1, text(200, 1)), (1, text(200, 50)), (2, text(200, 1)), (None, text(301, 60)), (None, text(301, 60) + " z1")]
    assert len({r[1] for r in brute.groups([(i, t) for i, (_, t) in enumerate(rows)])}) == 4
    whole = frame(spark, rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' as source", "1L as n_chars")
    found = corpus_pipeline.near_dedup(spark, whole, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in found)[:2] == sorted((str(d), t) for d, t in rows[:2]) and len(found) == 3


def test_lettered_texts_stay_where_no_language_is_labelled(spark, stored):
    whole = stored.selectExpr("doc_id", "text", "cast(null as string) lang", "'s' as source", "1L as n_chars")
    found = corpus_pipeline.language_id(spark, whole, "")
    assert found.count() == sum(any(c.isalpha() for c in t or "") for _, t in DOCS)


def test_decontamination_stage_with_other_splits(spark, stored, resplit, tmp_path):
    frame(spark, ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    whole = stored.selectExpr("doc_id", "text", "lang", "'s' as source", "1L as n_chars")
    resplit(winnowing, "contaminated_words")
    found = corpus_pipeline.decontamination(spark, whole, str(tmp_path))
    assert bag(found, "doc_id") == sorted(f"({r[0]},)" for r in brute.contaminated(DOCS, ITEMS) if not r[-1])


def test_simhash(stored):
    found = simhash.near_duplicates(stored)
    assert bag(found, "doc_id", "fingerprint", "component_id") == sorted(map(str, brute.groups(DOCS)))
    assert simhash.near_duplicates(stored.limit(0)).isEmpty()


def test_near_pairs_equal_all_pairs(spark):
    base = RNG.integers(0, 1 << 62, 40)
    values = np.unique(np.concatenate([base ^ (1 << np.int64(b)) ^ (1 << np.int64(7)) for b in range(0, 12, 3)]))
    df = spark.createDataFrame([(int(v),) for v in values], "_fp long")
    links = {(r.a, r.b) for r in simhash.near_pairs(df, 4, tile=16).collect()}
    parent = {int(v): int(v) for v in values}

    def components(pairs):
        at = dict(parent)

        def root(x):
            while at[x] != x:
                x = at[x]
            return x

        for a, b in pairs:
            at[root(a)] = root(b)
        return sorted(tuple(sorted(x for x in at if root(x) == r)) for r in {root(x) for x in at})

    every = [(int(a), int(b)) for a in values for b in values if a < b and int(a ^ b).bit_count() <= 4]
    assert components(links) == components(every) and all(int(a ^ b).bit_count() <= 4 for a, b in links)


def test_substring_dedup(stored):
    found = substring.remove_repeats(stored, keep=["lang"])
    expected = brute.without_repeats(DOCS)
    assert bag(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(map(str, expected))
    assert sum(r[2] > 0 for r in expected) >= 4
    assert substring.remove_repeats(stored.limit(0)).isEmpty()


def test_an_anchor_too_frequent_for_a_shard(spark, monkeypatch, tmp_path):
    hot = [PASSAGE, text(55, 6)]
    rows = [(i, f"{text(60, 100 + i)} {hot[i % 2]} {text(60, 200 + i)}") for i in range(60)]
    rows += [(60, rows[3][1]), (2, rows[4][1]), (61, " ".join(f"{text(60, 300 + i)} {hot[0]}" for i in range(20))), (70, PASSAGE)]
    frame(spark, rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    search = substring._search_shard

    def bounded(shard):
        if shard.num_rows > 60:
            raise ValueError(f"{shard.num_rows} passages in a shard")
        return search(shard)

    monkeypatch.setattr(substring, "SHARD_PASSAGES", 12)
    monkeypatch.setattr(substring, "_search_shard", bounded)
    found = substring.remove_repeats(spark.read.parquet(str(tmp_path / "d")))
    expected = brute.without_repeats(rows)
    assert bag(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(map(str, expected))
    assert sum(r[2] >= 55 for r in expected) >= 55


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(stored, order):
    found = ngram_lm.score_documents(stored, ngram_lm.held_out_fold(F.col("doc_id")), order=order).collect()
    place = lambda r: (str(tuple(r[:5])), r[5], r[6])
    found, expected = sorted(map(tuple, found), key=place), sorted(brute.ngram_scores(DOCS, order), key=place)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    for a, b in zip(found, expected, strict=True):
        assert a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6], abs=2e-4 * a[2])


@pytest.mark.parametrize("shards", [2, 5])
def test_language_model_in_shards(stored, monkeypatch, shards):
    monkeypatch.setattr(ngram_lm, "SHARD_CHARS", -(-sum(len(t or "") for _, t in DOCS) // shards))
    found = ngram_lm.score_documents(stored, ngram_lm.held_out_fold(F.col("doc_id")), order=3).collect()
    place = lambda r: (str(tuple(r[:5])), r[5], r[6])
    found, expected = sorted(map(tuple, found), key=place), sorted(brute.ngram_scores(DOCS, 3), key=place)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    for a, b in zip(found, expected, strict=True):
        assert a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6], abs=2e-4 * a[2])


@pytest.mark.parametrize("shards", [1, 2, 7])
def test_rounds_ask_each_shard_once(shards):
    asked = [(level, s) for parts in ngram_lm._rounds(shards, 4) for level, a, b in parts for s in range(a, b)]
    assert sorted(asked) == [(level, s) for level in range(1, 5) for s in range(shards)]


def test_each_round_leaves_the_disks(spark, stored, monkeypatch):
    cut, left = ngram_lm.cut_lineage, []
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffled():
        return {file for folder in folders for file in Path(folder).glob("*/shuffle_*.data")}

    def watched(*args, **kwargs):
        before = shuffled()
        out = cut(*args, **kwargs)
        until = time.monotonic() + 10
        while shuffled() - before and time.monotonic() < until:
            time.sleep(0.1)
        left.append(len(shuffled() - before))
        return out

    monkeypatch.setattr(ngram_lm, "cut_lineage", watched)
    monkeypatch.setattr(ngram_lm, "SHARD_CHARS", 2_000)
    setting = spark.conf.get(DROP_SHUFFLES, None)
    ngram_lm.score_documents(stored, F.lit(False), order=3)
    assert left == [0] * 4  # the batches, words and pairs, two halves of the triples
    assert spark.conf.get(DROP_SHUFFLES, None) == setting


def test_language_model_of_nothing(stored):
    assert ngram_lm.score_documents(stored.limit(0), F.lit(False)).isEmpty()
    nothing_learned = ngram_lm.score_documents(stored, F.lit(True)).agg(F.max("n_known"), F.max("train_tokens")).first()
    assert tuple(nothing_learned) == (0, 0)


def test_language_model_with_other_splits(stored, resplit):
    def scores():
        found = ngram_lm.score_documents(stored, ngram_lm.held_out_fold(F.col("doc_id"))).collect()
        return sorted(str((r.doc_id, r.n_tokens, r.n_known, round(r.score, 9))) for r in found)

    expected = scores()
    resplit(ngram_lm, "cut_lineage")
    assert scores() == expected


def test_the_registered_model_is_of_three_words(spark, stored, tmp_path):
    stored.write.parquet(str(tmp_path / "documents.parquet"))
    held_out = ngram_lm.held_out_fold(F.col("doc_id"))
    found, three = queries.op4_lm_scoring(spark, str(tmp_path)), ngram_lm.score_documents(stored, held_out, order=3)
    assert [bag(df, "doc_id", F.round("score", 9)) for df in (found, three)] == [bag(three, "doc_id", F.round("score", 9))] * 2


def test_batches_are_bounded_by_bytes(spark):
    rows = spark.range(0, 80, 1, 1).selectExpr("id as _row", "repeat('ä ', 700000 * cast(id % 2 as int) + 10000) as text")
    batches = rows.groupBy(ngram_lm.batch_number()).agg(F.sum(F.octet_length("text")), F.count("*")).collect()
    assert sum(r[2] for r in batches) == 80 and all(r[1] <= 32 << 20 or r[2] == 1 for r in batches)


def test_trigrams_score_a_copied_text_higher(stored):
    two, three = (
        {r.doc_id: r.score for r in ngram_lm.score_documents(stored, F.lit(False), order=n).collect()} for n in (2, 3)
    )
    assert three[1] > two[1]


def test_token_histogram(docs):
    encode = token_counts.encoding(token_counts.VOCABULARY).encode_ordinary
    sizes = sorted(len(encode(t or "")) for _, t in DOCS)
    rows = token_counts.length_histogram(token_counts.encoded_lengths(docs), width=16).orderBy("n_tokens")
    found = rows.collect()
    assert [(r.n_tokens, r.n_docs) for r in found] == [(n, sizes.count(n)) for n in sorted(set(sizes))]
    for r in found:
        assert r.docs_over == sum(s > r.n_tokens for s in sizes) and r.tokens_over == sum(s for s in sizes if s > r.n_tokens)
        assert r.truncated_total == sum(min(s, r.n_tokens) for s in sizes)
    answers = token_counts.at_limits(rows, [0, 5, 10_000]).collect()
    assert [(r.limit, r.docs_over, r.tokens_left) for r in answers] == [
        (k, sum(s > k for s in sizes), sum(min(s, k) for s in sizes)) for k in (0, 5, 10_000)
    ]
    assert token_counts.length_histogram(token_counts.encoded_lengths(docs.limit(0))).isEmpty()


def all_ways(vocab, word):
    """Every segmentation of a word as score, lengths of its pieces and ids, in the order of the tie rule."""
    out = []

    def go(at, score, sizes, ids):
        if at == len(word):
            out.append((-score, sizes, ids))
            return
        for end in range(at + 1, min(len(word), at + vocab.longest) + 1):
            if hit := vocab.score.get(word[at:end]):
                go(end, score + hit[0] - sentence_pieces.COST, (*sizes, at - end), (*ids, hit[1]))
        if word[at] not in vocab.score:
            spelled = vocab.spell(word[at])
            go(at + 1, score + vocab.unknown - sentence_pieces.COST * len(spelled), (*sizes, -1), (*ids, *spelled))

    go(0, 0.0, (), ())
    return sorted(out)  # best score, then the longer first piece


def ways_of_text(vocab, given, n):
    """The n best of all combinations of the words' ways: by score, then by the ranks of the ways, first word first."""
    words = re.findall(f"\n|{sentence_pieces.SPACE}*[^{sentence_pieces.SPACE}\n]+|{sentence_pieces.SPACE}+", (" " + given).replace(" ", sentence_pieces.SPACE))
    combined = [(0.0, (), ())]
    for word in words:
        ways = all_ways(vocab, word)
        combined = sorted(
            (cost + c, (*ranks, k), (*ids, *more)) for cost, ranks, ids in combined for k, (c, _, more) in enumerate(ways[:n])
        )[:n]
    return [(-cost, ids) for cost, _, ids in combined]


TEXTS = ["the cat", "hello a", "  a  b", "x\ny", "Éà ß", "日本 ab\U0001f600", "aaaa aa", "the the", "-----------", "-- -- -- a", "aaa bb aaa bb"]


@pytest.mark.parametrize("given", TEXTS)
def test_n_best_equals_all_ways(given):
    vocab = sentence_pieces.vocabulary(sentence_pieces.VOCABULARY)
    for n in (1, 2, 3, 6):
        found = next(iter(sentence_pieces.Encoder(vocab).encode(pa.array([given]), n)))
        expected = ways_of_text(vocab, given, n)
        assert [(s, tuple(ids.tolist())) for s, ids in found] == expected
    assert all(vocab.decode(ids) == given for _, ids in found)


@pytest.mark.parametrize("given", TEXTS)
def test_long_words_equal_all_ways(given, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "LONG_WORD", 0)
    test_n_best_equals_all_ways(given)


def best_by_places(vocab, word, n):
    """The n best ways by the tie rule, from each place on, without a search."""
    from_here = {len(word): [(0.0, 0, 0, 0)]}
    for place in range(len(word) - 1, -1, -1):
        ways = []
        for end in range(place + 1, min(len(word), place + vocab.longest) + 1):
            if hit := vocab.score.get(word[place:end]):
                ways += [(-(hit[0] - sentence_pieces.COST) + w[0], -end, k, hit[1]) for k, w in enumerate(from_here[end])]
        from_here[place] = sorted(ways)[:n]
    out = []
    for k in range(len(from_here[0])):
        ids, at, rank = [], 0, k
        while at < len(word):
            _, end, rest, piece = from_here[at][rank]
            ids.append(piece)
            at, rank = -end, rest
        out.append((-from_here[0][k][0], tuple(ids)))
    return out


@pytest.mark.parametrize("letters", ["-", "a", "the", "ab-"])
@pytest.mark.parametrize("length", [8, 40, 255, 256, 257, 10_000])
def test_ties_are_settled_alike_at_every_length(letters, length):
    """Just below, at and above the length from which words are searched one by one."""
    vocab = sentence_pieces.vocabulary(sentence_pieces.VOCABULARY)
    word = (letters * length)[: length - 1]  # the space in front is part of the word
    given = sentence_pieces.SPACE + word
    for n in (1, 3) if length < 10_000 else (3,):
        found = next(iter(sentence_pieces.Encoder(vocab).encode(pa.array([word]), n)))
        assert [(s, tuple(ids.tolist())) for s, ids in found] == best_by_places(vocab, given, n)


def test_a_long_run_of_one_character(monkeypatch):
    pops, pop = [], sentence_pieces.heapq.heappop

    def counted(queue):
        pops.append(1)
        if len(pops) > 3 * 4 * 10_100:
            raise MemoryError("the search widens")
        return pop(queue)

    monkeypatch.setattr(sentence_pieces.heapq, "heappop", counted)
    vocab = sentence_pieces.vocabulary(sentence_pieces.VOCABULARY)
    for n in (1, 3):
        found = next(iter(sentence_pieces.Encoder(vocab).encode(pa.array(["-" * 10_003]), n)))
        assert len({tuple(ids.tolist()) for _, ids in found}) == n
        assert all(vocab.decode(ids) == "-" * 10_003 for _, ids in found)


def test_segmentations(docs):
    columns = ("rank", "score", "n_pieces", "ids", "text", "round_trip")
    found = sentence_pieces.segmentations(docs, 2, columns).collect()
    assert all(r.round_trip for r in found) and sum(r["rank"] == 1 for r in found) == len(DOCS)
    assert {(r.n_pieces, r.text) for r in found if r.doc_id in (4, 5)} == {(0, "")}
    assert all(r.n_pieces == len(r.ids) for r in found)
    assert sentence_pieces.segmentations(docs.limit(0)).isEmpty()
    long_word = "ab" * 200
    vocab = sentence_pieces.vocabulary(sentence_pieces.VOCABULARY)
    best = next(iter(sentence_pieces.Encoder(vocab).encode(pa.array([long_word]), 1)))[0]
    assert vocab.decode(best[1]) == long_word


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie notice">We use cookies, a lot.</div><article><h1>A &amp; B</h1><p>First,  <b>bold</b>&nbsp;text.<br>More.
<p>Second &lt;one&gt; here, long enough.</article><div id="comments"><p>Great post, thanks!</p></div><form><p>Name, please.</p></form>
<script>var a = "<p>no</p>";</script><footer>&copy; Us.</footer></body></html>"""


def test_html(spark):
    pages = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "plain"), (4, "x", "<p <<>><!-- open"),
             (5, "y", "<p>" + "long text, yes. " * 50_000)]
    found = html_extract.extract_pages(frame(spark, pages, "page_id long, url string, html string")).collect()
    texts = sorted((str(r.page_id), r.text) for r in found)
    article = "A & B\n\nFirst, bold text. More.\n\nSecond <one> here, long enough."
    assert texts[:3] == [("1", article), ("1", article), ("2", "")] and ("None", "plain") in texts
    assert all(r.n_chars == len(r.text) for r in found) and max(r.n_chars for r in found) > 700_000
    assert html_extract.extract_pages(frame(spark, pages, "page_id long, url string, html string").limit(0)).isEmpty()


def test_html_keeps_short_parts_of_an_article():
    line = "A sentence of the article, with commas, points, and so on, that goes on for a while. "
    paragraphs = [(line * 5).strip() for _ in range(6)]
    parts = ["Points", "one item of the list", "another item", "Term", "its meaning", "Cell", "42", "Caption", "To be.", "x = 1"]
    p, (h, i, j, t, m, a, b, c, q, x) = paragraphs, parts
    long = "entry-content " + "wide " * 10
    page = (
        f'<body><div class="links"><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></div><div class="{long}text">'
        f"<p>{p[0]}</p><p>{p[1]}</p><h2>{h}</h2><ul><li>{i}<li>{j}</ul><section><p>{p[2]}</p></section><dl><dt>{t}<dd>{m}</dl>"
        f"<p>{p[3]}</p><table><tr><td>{a}<td>{b}</table><figure><figcaption>{c}</figcaption></figure><p>{p[4]}</p>"
        f"<blockquote>{q}</blockquote><pre>{x}</pre><ul><li><a href=c>Read this too</a></ul><p>{p[5]}</p></div>"
        f'<div class="{long}end"><p>Short end.</p></div></body>'
    )
    expected = [p[0], p[1], h, i, j, p[2], t, m, p[3], a, b, c, p[4], q, x, p[5]]
    assert html_extract.main_text(page).split("\n\n") == expected


def test_top_k(spark):
    vectors = [(int(i), [float(x) for x in RNG.normal(size=6).round(1)]) for i in range(120)]
    vectors += [(7, vectors[8][1]), (200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (None, [1.0] * 6),
                (203, [float("inf")] * 6), (204, [0.0] * 6), (250, [0.0] * 6), (300, []), (301, [1e30] * 6)]
    df = frame(spark, vectors, "vec_id long, embedding array<double>")
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, k=5, block_rows=40, query_rows=2)
    whole = [(i, [int(np.floor(256 * x)) if abs(x) < 1e20 else (1 << 63) - 1 for x in v]) for i, v in vectors
             if i is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v)]
    expected = []
    for q, qv in {(q, tuple(v)) for q, v in whole if q % 50 == 0}:
        scored = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(qv, v, strict=True)))), i)
                  for i, v in whole if i != q and len(v) == len(qv)]
        expected += [(q, k + 1, i, s) for k, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:5])]
    assert bag(found, "query_id", "rank", "vec_id", "score") == sorted(map(str, expected))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).isEmpty()


def test_the_threshold_stops_early():
    values = np.eye(64)[RNG.integers(0, 64, 4096)] * RNG.integers(1, 10_000, (4096, 1))
    lists = topk.Lists(np.arange(4096), values)
    query = np.zeros(64)
    query[3] = 5
    best, scores, depth = lists.top(query, None, 5)
    assert depth < 1024 and (scores == np.sort(values @ query)[::-1][:5]).all()


def test_languages(spark, docs):
    rows = [(i, ("the and of " if i % 2 else "der die und ") * 20, "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 %%", "de"), (None, "the and of the", None)]
    df = frame(spark, rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.col("doc_id") % 5 != 0, per_language=50)
    found = {r.doc_id: r for r in langid.predict(df, model, ["doc_id"]).collect()}
    assert all(found[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (100, 101, 102)) and found[None].lang_pred == "en"
    assert {r.lang_pred for r in langid.predict(df, None, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(df.limit(0)).isEmpty()


def test_the_network_by_lanes_equals_the_plain_one():
    model = langid.ByteTagger(["a", "b", "c"])
    sizes = [0, 5, 127, 128, 129, 1000]
    data = RNG.integers(32, 250, sum(sizes)).astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    found = model.documents(data, offsets)
    for i, n in enumerate(sizes):
        own = data[offsets[i] : offsets[i + 1]].astype(np.int64)
        total = sum(model.positions(own[s : s + langid.WINDOW, None])[0][:, 0].sum(axis=0) for s in range(0, n, langid.WINDOW))
        assert np.allclose(found[i], total / max(n, 1), atol=1e-4)


def test_toxicity(spark):
    rows = [(i, text(30, 100 + i) + (" you Moron " if i % 4 == 0 else " fine ") + text(30, 500 + i), "en") for i in range(240)]
    rows += [(1000, None, "en"), (1001, "", None), (None, "x", "fr")]
    labels = [(i, int(i % 4 == 0)) for i in range(240)] + [(3, None), (None, 1), (5, 7)]
    documents = frame(spark, rows, "doc_id long, text string, lang string")
    known = frame(spark, labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score_documents(documents, known).collect()}
    right = [found[i].predicted == int(i % 4 == 0) for i in range(240) if found[i].held_out]
    assert len(right) > 30 and np.mean(right) > 0.9 and len(found) == 243
    assert found[1000].score == found[1001].score and 0 <= found[1000].score < 0.5
    assert {r.score for r in toxicity.score_documents(documents, known.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(documents.limit(0), known).isEmpty()
