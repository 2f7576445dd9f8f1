"""Periodic runs, mixing of sources and whitening against plain versions and SQL."""

from __future__ import annotations

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiloom.llm import mixing, periodic, queries, whitening
from tests.llm import brute
from tests.llm.test_operators import DOCS, bag, frame, text

pytestmark = pytest.mark.usefixtures("light")

# --- periodic runs -------------------------------------------------------------------

LOOP = " ".join(f"v{i}" for i in range(150))
RUNNING = [
    *DOCS,
    (20, "a b c " * 8 + text(30, 7) + " x y" * 5),
    (21, "a b \x0b c\x1c " * 7),  # no-break and separator characters are parts of words
    (22, (LOOP + " ") * 3 + "v0 v1 tail"),
    (23, ("a " * 90 + "b ") * 4),
    (24, "a " * 11),
    (25, "a " * 12),
    (26, "a b c d e f " * 2),
    (27, "a b c d e f g " * 2 + "a b"),
    *[(i, text(40 + i, i)) for i in range(30, 75)],  # some of these are made to repeat themselves
]


def sequences(trial):
    rng = random.Random(trial)
    for _ in range(rng.randint(1, 4)):
        n, kinds = rng.choice([0, 5, 30, 100, 400]), rng.choice([1, 2, 3, 10, 200])
        words = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 20:
                a, e = sorted((rng.randrange(n), rng.randrange(n)))
                p = rng.randint(1, max(1, (e - a) // 2))
                for i in range(a, e):
                    words[i] = words[a + (i - a) % p]
        if n and not rng.randrange(5):
            k = rng.randint(1, n)
            words = [int(i % k == 0) for i in range(n)]
        if not rng.randrange(8):
            short, words = [0], [0, 1]
            while len(words) < n:
                short, words = words, words + short
            words = words[:n]
        yield words


@pytest.mark.parametrize("least", [12, 6])
def test_runs_are_those_of_the_definition(least):
    for trial in range(60):
        parts, expected, at = list(sequences(trial)), [], 0
        for words in parts:
            expected += [(at + s, n, q) for s, n, q in brute.runs(words, least)]
            at += len(words)
        flat = np.array(sum(parts, []), np.int64)
        found = periodic.find_runs(flat, np.array([len(p) for p in parts], np.int64), least)
        assert list(zip(*(x.tolist() for x in found), strict=True)) == expected, trial


def test_splitting_recurs():
    # 7 is alone and splits; so is 5 then in both parts, and 3 in those of the first.
    words = np.array([3, 1, 1, 5, 1, 1, 3, 7, 5, 2, 2], np.int64)
    begin, end = periodic.split_rare(words, 1, np.array([0]), np.array([11]), 2)
    assert list(zip(begin.tolist(), end.tolist(), strict=True)) == [(1, 3), (4, 6), (9, 11)]


def test_words_of_long_texts_are_read_in_parts(monkeypatch):
    whole = ("aa \t b\n" * 50 + "c" * 300 + " aa").encode()
    numbers = periodic.defaultdict(periodic.count().__next__)
    expected = periodic.word_numbers(whole, numbers).tolist()
    monkeypatch.setattr(periodic, "CHUNK", 16)
    assert periodic.word_numbers(whole, numbers).tolist() == expected and len(numbers) == 3
    names = list(numbers)
    assert periodic._joined(np.array(expected), names) == b" ".join(whole.split())


def test_periodic_query(spark, tmp_path):
    docs = frame(spark, RUNNING, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_periodic_runs(spark, str(tmp_path))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    expected = brute.periodic(RUNNING)
    assert bag(found, *columns) == sorted(map(str, expected))
    assert sum(r[1] for r in expected) > 15 and max(r[4] or 0 for r in expected) == 150
    kinds = dict(found.dtypes)
    assert all(kinds[c] == "bigint" for c in columns[:6])


def test_periodic_operator_gives_runs_and_texts(spark):
    docs = frame(spark, [(1, "x " + "a b c " * 5 + "end"), (None, None), (2, ""), (2, "")], "doc_id long, text string")
    found = periodic.periodic_runs(docs)
    rows = {(r["doc_id"], r["n_words"], str([tuple(x) for x in r["runs"]]), r["collapsed"]) for r in found.collect()}
    assert rows == {(1, 17, "[(1, 15, 3)]", "x a b c end"), (None, 0, "[]", ""), (2, 0, "[]", "")}
    assert found.count() == 4 and periodic.periodic_runs(docs.limit(0)).isEmpty()


def test_periodic_runs_of_a_very_long_text(spark):
    period = text(40_000, 11).split()
    words = period * 5 + ["odd"] + text(100_000, 12).split() + ["z"] * 200_000
    docs = frame(spark, [(1, " ".join(words))], "doc_id long, text string")
    row = periodic.periodic_runs(docs).first()
    assert (0, 200_000, 40_000) in [tuple(r) for r in row["runs"]]
    assert (300_001, 200_000, 1) in [tuple(r) for r in row["runs"]]
    assert len(row["collapsed"].split()) <= 40_000 + 1 + 100_000 + 1


# --- mixing --------------------------------------------------------------------------


def sources_of(rows):
    names = ["b", "a", "Z", "é", None, "c", "hot", "empty"]
    out = []
    for i, (doc_id, words) in enumerate(rows):
        source = names[i % 6] if i % 3 else "hot"
        out.append((doc_id, words if i % 17 else None, source))
    return out + [(900 + i, "", "empty") for i in range(3)]


MIXED = sources_of([(i, text(5 + (i * 37) % 90, i)) for i in range(160)] + [*DOCS, (7, "x y"), (7, "x y")])
MIXED += [(2000, "same words here", "rep")] * 25 + [(3000, text(2000, 1), "big"), (3001, "one", "big")]


@pytest.fixture
def mixed(spark, tmp_path):
    frame(spark, MIXED, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def by_source(rows):
    out = defaultdict(int)
    for r in rows:
        out[r["source"]] += r["taken"]
    return out


def test_mix_meets_its_targets(spark, mixed):
    rows = queries.op12_source_mix(spark, mixed).collect()
    sizes = defaultdict(int)
    for _, words, source in MIXED:
        sizes[source] += len((words or "").split())
    targets = brute.targets(sizes)
    assert len(rows) == len(MIXED)
    assert {r["source"]: (r["source_size"], r["target"]) for r in rows} == {
        s: (sizes[s], pytest.approx(targets[s])) for s in sizes
    }
    taken = by_source(rows)
    assert all(0 <= targets[s] - taken[s] < 1 for s in sizes)  # whole words: only the fraction is missing
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    # All but one document a source gives whole copies.
    parts = [r["source"] for r in rows if r["size"] and r["taken"] % r["size"]]
    assert len(parts) == len(set(parts))
    assert any(t == 2 * sizes[s] for s, t in targets.items()) and targets["empty"] == 0


def test_mix_equals_its_sql(spark, mixed):
    found = queries.op12_source_mix(spark, mixed)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{mixed}/documents.parquet/*.parquet'")
    columns = ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE['op12_source_mix']})").fetchall()
    assert bag(found, *columns) == sorted(map(str, expected))
    assert bag(queries.op12_source_mix(spark, mixed), *columns) == bag(found, *columns)


def test_mix_does_not_follow_the_splits(spark, mixed):
    before = bag(queries.op12_source_mix(spark, mixed), "doc_id", "source", "size", "taken")
    docs = spark.read.parquet(f"{mixed}/documents.parquet").repartition(7)
    assert bag(mixing.mix(docs), "doc_id", "source", "size", "taken") == before


def test_a_sample_follows_its_inclusion(spark):
    """Equal documents in two sources of shares 0.25 and 0.75: ranks below 1 are nearly those taken."""
    n = 4000
    rows = spark.range(n).select(
        F.col("id").alias("doc_id"), F.lit("word word").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source")
    )
    found = mixing.mix(rows, weights=(1, 3), share=(1, 2), copies=1)
    taken = found.groupBy("source").agg(F.sum("taken").alias("t"), F.count_if(F.col("taken") > 0).alias("docs")).collect()
    assert {r["source"]: (r["t"], r["docs"]) for r in taken} == {"a": (1000, 500), "b": (3000, 1500)}
    draws = found.where("source = 'a' AND taken > 0").select(F.pmod("doc_id", F.lit(20)).alias("k")).groupBy("k").count().collect()
    assert len(draws) == 10 and min(r["count"] for r in draws) > 20  # spread over all ids


def test_mix_of_nothing(spark):
    docs = frame(spark, MIXED[:4], "doc_id long, text string, source string")
    assert mixing.mix(docs.limit(0)).isEmpty()
    wordless = frame(spark, [(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert bag(mixing.mix(wordless), "doc_id", "target", "taken") == ["(1, 0.0, 0)", "(2, 0.0, 0)"]


# --- whitening -----------------------------------------------------------------------


def exact(vectors, scale=1024, offset=100_000):
    """Row count, deviations and eigenpairs from whole numbers; the covariance is exact before it becomes doubles."""
    whole = [[int(np.floor(scale * np.float64(c))) + offset for c in v] for v in vectors]
    n, d = len(whole), len(whole[0])
    sums = [sum(r[i] for r in whole) for i in range(d)]
    spread = [[n * r[i] - sums[i] for i in range(d)] for r in whole]
    gram = np.array([[float(sum(r[i] * r[j] for r in spread)) / n**3 for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(gram)
    centred = np.array([[x / n for x in r] for r in spread])
    return [sum(x * x for x in r) for r in spread], values[::-1], axes[:, ::-1], centred


def check_whitening(found, ids, vectors, k, tolerance):
    deviation, values, axes, centred = exact(vectors)
    rows = defaultdict(dict)
    for r in found.collect():
        assert r["n"] == len(ids) and r["identity_error"] < 1e-4
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9
        rows[r["vec_id"]][r["component"]] = r
    assert sorted(rows) == sorted(ids)
    white = np.array([[rows[i][c + 1]["whitened"] for c in range(k)] for i in ids])
    assert all(len(rows[i]) == k for i in ids)
    assert [rows[i][1]["deviation"] for i in ids] == deviation
    expected = centred @ axes[:, :k] / np.sqrt(values[:k])
    expected *= np.sign((expected * white).sum(axis=0))
    assert np.abs(expected - white).max() < tolerance


def test_whitening(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(300, 12)) * np.geomspace(1, 40, 12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    vectors = vectors.astype(np.float32).tolist()
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    broken = [(900, None, 1), (901, [1.0, None] * 6, 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] * 12, 1)]
    frame(spark, rows + broken, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op13_whitening(spark, str(tmp_path))
    check_whitening(found, list(range(300)), vectors, 8, 1e-9)
    assert dict(found.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
        "whitened": "double", "explained": "double", "identity_error": "double",
    }


def test_whitening_of_hard_spectra(spark):
    """Deviations from 1 to 10**10 and two copies of a column: the first Gram matrix is far from positive."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(200, 10)) * np.geomspace(1e-2, 1e8, 10)
    vectors = np.hstack([vectors, vectors[:, :2], np.full((200, 1), 3.0)])
    rows = frame(spark, [(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    found = whitening.whiten(rows, components=13)
    measured = {r["component"]: r for r in found.where("vec_id = 0").collect()}
    assert sorted(measured) == list(range(1, 11))  # twelve columns and a constant span ten directions
    # Singular values of the centred rows, whose accuracy does not suffer from forming a covariance.
    centred = np.floor(1024 * vectors) - np.floor(1024 * vectors).mean(axis=0)
    sizes = np.linalg.svd(centred, compute_uv=False)
    for c in range(10):
        assert abs(measured[c + 1]["explained"] / (sizes[c] ** 2 / (sizes**2).sum()) - 1) < 1e-6, c
    assert measured[1]["identity_error"] < 1e-4


def test_shifted_passes_reach_orthonormal_rows(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(150, 6)) @ np.diag(np.geomspace(1, 1e9, 6)) @ rng.normal(size=(6, 6))
    rows = whitening.usable(frame(spark, [(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>"))
    fit = whitening._fit(rows, 1024, 0)
    sizes, right, passes = whitening.singular(rows, fit)
    whole = np.floor(1024 * vectors)
    expected = np.linalg.svd(whole - whole.mean(axis=0), compute_uv=False)
    assert 3 <= passes <= whitening.PASSES and np.allclose(sizes, expected, rtol=1e-7)
    assert np.allclose(right @ right.T, np.eye(6), atol=1e-12)


def test_whitening_edges(spark):
    kinds = "vec_id long, embedding array<float>"
    assert whitening.whiten(frame(spark, [(1, [0.5, 1.0])], kinds).limit(0)).isEmpty()
    assert whitening.whiten(frame(spark, [(1, [0.5, 1.0])] * 3, kinds)).isEmpty()  # no spread
    assert whitening.whiten(frame(spark, [(1, None), (2, [None])], kinds)).isEmpty()
    assert whitening.whiten(frame(spark, [(1, []), (2, [])], kinds)).isEmpty()
    # Short vectors end in zeros; repeated and null ids are vectors like others.
    rows = [(1, [1.0, 2.0, 0.5]), (2, [3.0]), (2, [3.0]), (None, [-1.0, 4.0, 0.0]), (5, [])]
    found = whitening.whiten(frame(spark, rows, kinds))
    assert found.count() == 15 and found.where("vec_id is null").count() == 3
    padded = [(v + [0.0] * 3)[:3] for _, v in rows]
    deviation, *_ = exact(padded)
    assert sorted(r["deviation"] for r in found.where("component = 1").collect()) == sorted(deviation)
    huge = frame(spark, [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 9.0])], "vec_id long, embedding array<double>")
    largest = {r["vec_id"]: r["deviation"] for r in whitening.whiten(huge).where("component = 1").collect()}
    assert largest[1] == (1 << 63) - 1 and largest[2] == (1 << 63) - 1
