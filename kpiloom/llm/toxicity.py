"""Toxicity by a convolutional text classifier in numpy.

Words are hashed to embeddings (the word and its first letters share the work, so that forms
of one stem are alike), filters of several widths run over the text, and the largest answer of
each filter feeds a logistic layer. It is learned from all labelled texts, whole, in rounds: bundles
of texts each go on from the model of the round before, and what they change is added up by
Spark. Thresholds are calibrated per language on rows kept back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.llm.common import crc_fold, pieces_of
from kpiloom.llm.flat import span_hashes, words_of
from kpiloom.session import cut_lineage

WORD_BUCKETS, STEM_BUCKETS = 1 << 17, 1 << 14
STEM_BYTES = 4
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 16
PAD = 0  # bucket of the places between texts; its embeddings stay 0
THRESHOLD = 0.3
ROUNDS, RATE, BATCH = 8, 0.05, 64
VISITS = 150 * BATCH  # of texts that a fit of few rows makes at least, and a bundle in half the rounds
BATCH_WORDS = 1 << 16  # words of a step's texts, or one text
BUNDLE_ROWS, BUNDLE_BYTES = 4096, 16 << 20  # texts of a bundle, on average
BINS = 10_000  # steps of a score that a threshold may lie at
SLICE = 1 << 17  # numbers of a sum that are added up in one group


Buckets = tuple[np.ndarray, np.ndarray, np.ndarray]


def buckets(texts: pa.Array) -> Buckets:
    """Word and stem buckets (32 bits) of all texts in a row, WIDTHS[-1] PADs after each, and where each begins."""
    words = words_of(texts, lower=True)
    word = (span_hashes(words.data, words.start, words.end) % (WORD_BUCKETS - 1) + 1).astype(np.int32)
    stem_end = np.minimum(words.end, words.start + STEM_BYTES)
    stem = (span_hashes(words.data, words.start, stem_end) % (STEM_BUCKETS - 1) + 1).astype(np.int32)
    gap = WIDTHS[-1]
    owner = np.repeat(np.arange(len(texts)), words.count)
    place = np.arange(len(word)) + gap * owner
    total = len(word) + gap * len(texts)
    out = np.zeros((2, total), np.int32)
    out[0, place], out[1, place] = word, stem
    return out[0], out[1], words.first[:-1] + gap * np.arange(len(texts))


class WordFilters:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f32 = np.float32
        self.word = rng.normal(0, 0.02, (WORD_BUCKETS, SIZE)).astype(f32)
        self.stem = rng.normal(0, 0.02, (STEM_BUCKETS, SIZE)).astype(f32)
        self.word[PAD] = self.stem[PAD] = 0
        self.filters = [rng.normal(0, 0.5, (w, SIZE, FILTERS)).astype(f32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, f32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(f32)
        self.shift = np.zeros(1, f32)

    def pooled(self, word: np.ndarray, stem: np.ndarray, begin: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """The largest answer (text, filter); long inputs are worked off in blocks of whole texts."""
        found = np.empty((len(begin), len(self.bias)), np.float32)
        edges = np.append(begin, len(word))
        i = 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + block, side="right")) - 1)
            part = slice(int(edges[i]), int(edges[j]))
            found[i:j] = self._peaks(word[part], stem[part], begin[i:j] - edges[i])
            i = j
        return found

    def _embedded(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """The embeddings as (coordinate, place): numpy searches a text fast where its places are neighbours."""
        embedded = self.word.take(word, axis=0)
        embedded += self.stem.take(stem, axis=0)
        return np.ascontiguousarray(embedded.T)

    def _answers(self, embedded: np.ndarray, w: int, begin: np.ndarray) -> np.ndarray:
        """What the filters of a width answer, as (filter, place)."""
        n = embedded.shape[1]
        answers = self.filters[w][0].T @ embedded
        for k in range(1, WIDTHS[w]):
            answers[:, : n - k] += self.filters[w][k].T @ embedded[:, k:]
        # From the last places a filter would reach into the next text.
        ends = np.append(begin[1:], n)
        for k in range(1, WIDTHS[-1]):
            answers[:, ends - k] = -np.inf
        return answers

    def _peaks(self, word: np.ndarray, stem: np.ndarray, begin: np.ndarray) -> np.ndarray:
        embedded = self._embedded(word, stem)
        return np.concatenate(
            [np.maximum.reduceat(self._answers(embedded, w, begin), begin, axis=1) for w in range(len(WIDTHS))]
        ).T

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift[0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        return self.scores_of(buckets(texts))

    def scores_of(self, found: Buckets) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(self.pooled(*found)).astype(np.float64)))

    def fit(
        self, sample: Buckets, labels: np.ndarray, weights: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.05
    ) -> None:
        word, stem, begin = sample
        edges = np.append(begin, len(word))
        # The largest answer alone is learned from, so words that part the classes must stand out
        # from the start: one coordinate of each embedding begins as how far the bucket's texts
        # lean to class 1, in deviations, and a quarter of the filters begin by reading it.
        owner = np.repeat(np.arange(len(labels)), np.diff(edges))
        mean = labels.mean()
        self.lean_by(
            *(_lean(*_bucket_texts(x, owner, labels, size), mean) for x, size in ((word, WORD_BUCKETS), (stem, STEM_BUCKETS)))
        )
        epochs = max(epochs, -(-VISITS // max(len(labels), 1)))  # few rows are gone over more often
        self.descend(sample, labels, weights, [rate / (1 + 5 * epoch / epochs) for epoch in range(epochs)], batch)

    def lean_by(self, word: np.ndarray, stem: np.ndarray) -> None:
        self.word[:, 0], self.stem[:, 1] = word, stem
        for f in self.filters:
            f[:, 0, : FILTERS // 8] = f[:, 1, FILTERS // 8 : FILTERS // 4] = 1 / len(f)

    @property
    def params(self) -> list[np.ndarray]:
        return [self.word, self.stem, *self.filters, self.bias, self.out, self.shift]

    def descend(
        self, sample: Buckets, labels: np.ndarray, weights: np.ndarray, rates: list[float], batch: int = BATCH, seed: int = 13
    ) -> None:
        """Go over the rows once for each rate, in an order of its own."""
        word, stem, begin = sample
        edges = np.append(begin, len(word))
        rng = np.random.default_rng(seed)
        params = self.params
        seen = [np.full(p.shape, 1e-2, np.float32) for p in params]
        for rate in rates:
            order = rng.permutation(len(labels))
            held = np.cumsum((edges[1:] - edges[:-1])[order])
            at = 0
            while at < len(order):
                before = held[at - 1] if at else 0
                most = int(np.searchsorted(held, before + BATCH_WORDS, side="right"))
                rows = order[at : max(at + 1, min(at + batch, most))]
                at += len(rows)
                sizes = edges[rows + 1] - edges[rows]
                starts = np.cumsum(sizes) - sizes
                index = np.arange(sizes.sum()) - np.repeat(starts, sizes) + np.repeat(edges[rows], sizes)
                self._step(word[index], stem[index], starts, labels[rows], weights[rows], params, seen, rate)

    def _step(self, word, stem, begin, labels, weights, params, seen, rate) -> None:
        embedded = self._embedded(word, stem)
        edges = np.append(begin, len(word)).tolist()
        peaks, places = [], []
        for w in range(len(WIDTHS)):
            answers = self._answers(embedded, w, begin)
            place = np.array([answers[:, a:b].argmax(axis=1) + a for a, b in zip(edges, edges[1:], strict=False)])
            peaks.append(answers[np.arange(FILTERS), place])
            places.append(place)
        hidden = np.concatenate(peaks, axis=1) + self.bias
        active = np.maximum(hidden, 0)
        p = 1 / (1 + np.exp(-(active @ self.out + self.shift[0])))
        g = ((p - labels) * weights / len(labels)).astype(np.float32)
        g_hidden = g[:, None] * self.out * (hidden > 0)
        touched_w, touched_s, rows = [], [], []
        grads_f = [np.zeros_like(f) for f in self.filters]
        for w, place in enumerate(places):
            gh = g_hidden[:, w * FILTERS : (w + 1) * FILTERS]
            for k in range(WIDTHS[w]):
                at = np.minimum(place + k, len(word) - 1)
                e = np.moveaxis(embedded[:, at], 0, -1)
                grads_f[w][k] = np.einsum("bfd,bf->df", e, gh)
                ge = gh[:, :, None] * self.filters[w][k].T[None]
                touched_w.append(word[at].ravel())
                touched_s.append(stem[at].ravel())
                rows.append(ge.ravel())
        moves = np.concatenate(rows)

        def sparse(param, total, ids) -> None:
            unique, inverse = np.unique(np.concatenate(ids), return_inverse=True)
            grad = np.zeros(len(unique) * SIZE, np.float32)
            np.add.at(grad, (inverse[:, None] * SIZE + np.arange(SIZE)).ravel(), moves)  # flat, it is quicker
            grad = grad.reshape(-1, SIZE)
            grad[unique == PAD] = 0
            total[unique] += grad * grad
            param[unique] -= rate * grad / np.sqrt(total[unique])

        sparse(params[0], seen[0], touched_w)
        sparse(params[1], seen[1], touched_s)
        dense = [*grads_f, g_hidden.sum(axis=0), active.T @ g, np.array([g.sum()], np.float32)]
        for param, total, grad in zip(params[2:], seen[2:], dense, strict=True):
            total += grad * grad
            param -= rate * grad / np.sqrt(total)


def _bucket_texts(bucket: np.ndarray, owner: np.ndarray, labels: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket, the texts that have it, and those of class 1 among them."""
    # Numbers of 32 bits, as those of a bundle are, sort in a fraction of the time of np.unique.
    kind = np.uint32 if len(labels) * size <= 1 << 32 else np.uint64
    pairs = np.sort(owner.astype(kind) * kind(size) + bucket.astype(kind))
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:] != pairs[:-1]
    texts, buckets_ = np.divmod(pairs[new].astype(np.int64), size)
    return np.bincount(buckets_, minlength=size), np.bincount(buckets_, weights=labels[texts], minlength=size)


def _lean(n: np.ndarray, ones: np.ndarray, mean: float) -> np.ndarray:
    """For each bucket, by how many deviations its texts of class 1 exceed the mean; -1 to 1."""
    lean = np.clip((ones - n * mean) / np.sqrt(n * mean * (1 - mean) + 1) / 5, -1, 1).astype(np.float32)
    lean[PAD] = 0
    return lean


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a sample as buckets, so that the driver gets whole numbers and hashes nothing."""
    for whole in batches:
        for batch in pieces_of(whole, "text"):
            word, stem, begin = buckets(batch.column("text"))
            offsets = pa.array(np.append(begin, len(word)), pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (word, stem)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "lang", "toxic")), *arrays], ["key", "lang", "toxic", "word", "stem"]
            )


def _chosen(taken: pa.Table, rows: np.ndarray) -> Buckets:
    part = taken.take(pa.array(rows))
    word, stem = (part.column(c).combine_chunks() for c in ("word", "stem"))
    sizes = word.value_lengths().to_numpy()
    return word.flatten().to_numpy(), stem.flatten().to_numpy(), np.cumsum(sizes) - sizes


STEM_BITS = STEM_BUCKETS.bit_length() - 1


def _packed(parts: int):
    """Each text as compressed numbers that hold the buckets of word and stem: these move, texts do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                word, stem, begin = buckets(batch.column("text"))
                both = (word.astype(np.uint32) << np.uint32(STEM_BITS)) | stem.astype(np.uint32)
                edges = np.append(begin, len(both))
                blobs = [zstandard.compress(both[a:b].tobytes(), 1) for a, b in zip(edges, edges[1:], strict=False)]
                key = batch.column("key")
                part = pa.array((key.to_numpy() % parts).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part, key, batch.column("lang"), pa.array(blobs, pa.binary())], ["part", "key", "lang", "packed"]
                )

    return run


def _bundle(texts: pa.Table, labelled: pa.Table) -> pa.Table:
    """The labelled texts of one part as one value, in order of key and label, repeated rows once."""
    keys, first = np.unique(texts.column("key").to_numpy(), return_index=True)
    labelled = labelled.sort_by([("key", "ascending"), ("toxic", "ascending")])
    wanted = labelled.column("key").to_numpy()
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    there = np.flatnonzero(keys[at] == wanted) if len(keys) else np.empty(0, np.int64)
    rows = texts.select(["key", "lang", "packed"]).take(pa.array(first[at[there]] if len(there) else there))
    rows = rows.append_column("toxic", labelled.column("toxic").take(pa.array(there))).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    blobs = [sink.getvalue().to_pybytes()] if len(there) else []
    return pa.table({"bundle": pa.array(blobs, pa.binary())})


def _bundles(batches: Iterator[pa.RecordBatch], kept_back: bool) -> Iterator[tuple[pa.Table, Buckets, np.ndarray]]:
    """Of each bundle the rows learned from, or the fifth kept back: the table, buckets and labels."""
    for batch in batches:
        for blob in batch.column("bundle"):
            rows = pa.ipc.open_stream(blob.as_buffer()).read_all()
            fifth = (rows.column("key").to_numpy() >> 20) % 5 == 0
            rows = rows.take(pa.array(np.flatnonzero(fifth == kept_back)))
            if not len(rows):
                continue
            both = [np.frombuffer(zstandard.decompress(x), np.uint32) for x in rows.column("packed").to_pylist()]
            sizes = np.array([len(x) for x in both])
            flat = np.concatenate(both)
            word, stem = (flat >> np.uint32(STEM_BITS)).astype(np.int32), (flat & np.uint32(STEM_BUCKETS - 1)).astype(np.int32)
            yield rows, (word, stem, np.cumsum(sizes) - sizes), rows.column("toxic").to_numpy().astype(np.float32)


def _summed(bundles: DataFrame, count) -> list[np.ndarray]:
    """The arrays that `count` gives for each bundle, added up: inside the tasks, then in slices by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, found, labels in _bundles(batches, False):
            own = count(found, labels)
            if total is None:
                total = [x.astype(np.float64) for x in own]
            else:
                for x, y in zip(total, own, strict=True):
                    x += y
        for name, x in enumerate(total or []):
            for at in range(0, len(x), SLICE):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name], pa.int32()), pa.array([at], pa.int32()), pa.array([zstandard.compress(x[at : at + SLICE].tobytes(), 1)])],
                    ["name", "at", "numbers"],
                )

    def add(slices: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zstandard.decompress(x), np.float64) for x in slices.column("numbers").to_pylist())
        return slices.slice(0, 1).set_column(2, "numbers", pa.array([zstandard.compress(total.tobytes(), 1)]))

    schema = "name int, at int, numbers binary"
    parts = bundles.mapInArrow(run, schema).groupBy("name", "at").applyInArrow(add, schema).toArrow()
    parts = parts.sort_by([("name", "ascending"), ("at", "ascending")])
    found: dict[int, list[np.ndarray]] = {}
    for name, x in zip(parts.column("name").to_pylist(), parts.column("numbers").to_pylist(), strict=True):
        found.setdefault(name, []).append(np.frombuffer(zstandard.decompress(x), np.float64))
    return [np.concatenate(x) for _, x in sorted(found.items())]


def _counted(found: Buckets, labels: np.ndarray) -> list[np.ndarray]:
    word, stem, begin = found
    owner = np.repeat(np.arange(len(labels)), np.diff(np.append(begin, len(word))))
    in_word, in_stem = _bucket_texts(word, owner, labels, WORD_BUCKETS), _bucket_texts(stem, owner, labels, STEM_BUCKETS)
    return [np.array([len(labels), labels.sum()]), *in_word, *in_stem]


def _moved(model: WordFilters, turn: int):
    """How far a bundle moves the parameters of a model, and which embeddings it moves at all."""

    def run(found: Buckets, labels: np.ndarray) -> list[np.ndarray]:
        own = WordFilters()
        for x, y in zip(own.params, model.params, strict=True):
            x[...] = y
        times = max(1, -(-2 * VISITS // (ROUNDS * len(labels))))  # few rows are gone over more often
        own.descend(found, labels, np.ones(len(labels), np.float32), [RATE / (1 + 5 * turn / ROUNDS)] * times, seed=13 + turn)
        steps = [x - y for x, y in zip(own.params, model.params, strict=True)]
        touched = [(x != 0).any(axis=1) for x in steps[:2]]
        dense = [x * np.float64(len(labels)) for x in steps[2:]]
        return [x.ravel() for x in (*steps[:2], *touched, *dense)]

    return run


def train_whole(documents: DataFrame, known: DataFrame) -> tuple[WordFilters, dict[str, float]] | None:
    """The classifier and thresholds from all labelled rows and their whole texts; see `train`.

    Texts become bucket numbers where they are; those move once, to bundles of about BUNDLE_ROWS texts by a hash
    of doc_id and text, which are written to the checkpoint folder. Of all bundles come the counts the
    embeddings start from. In each round every bundle descends from the model of the round before; an
    embedding moves by the mean of the bundles that moved it, all else by the mean over rows. Bundles and their
    order follow from the rows, so other splits of the files change no more than the rounding of sums.
    """
    rows = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text", F.lit(29)))
    labelled = rows.select("doc_id", "key").join(known.where(F.col("toxic").isin(0, 1)), "doc_id").select("key", "toxic").distinct()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, -(-size["n"] // BUNDLE_ROWS), -(-(size["bytes"] or 0) // BUNDLE_BYTES))
    packed = rows.select("key", "lang", "text").mapInArrow(_packed(parts), "part int, key long, lang string, packed binary")
    by_part = labelled.withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
    bundles = cut_lineage(packed.groupBy("part").cogroup(by_part.groupBy("part")).applyInArrow(_bundle, "bundle binary"))
    counted = _summed(bundles, _counted)
    if not counted or not 0 < counted[0][1] < counted[0][0]:
        return None
    model = WordFilters()
    total, ones = counted[0]
    model.lean_by(_lean(*counted[1:3], ones / total), _lean(*counted[3:5], ones / total))
    for turn in range(ROUNDS):
        word, stem, word_bundles, stem_bundles, *dense = _summed(bundles, _moved(model, turn))
        model.word += (word.reshape(-1, SIZE) / np.maximum(word_bundles, 1)[:, None]).astype(np.float32)
        model.stem += (stem.reshape(-1, SIZE) / np.maximum(stem_bundles, 1)[:, None]).astype(np.float32)
        for x, step in zip(model.params[2:], dense, strict=True):
            x += (step / total).reshape(x.shape).astype(np.float32)
    return model, _thresholds(bundles, model)


def _thresholds(bundles: DataFrame, model: WordFilters) -> dict[str, float]:
    """For each language of both classes the step of the score of best F1, over all rows kept back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found, labels in _bundles(batches, True):
            step = np.floor(model.scores_of(found) * BINS).astype(np.int32)
            lang = pa.array([x or "" for x in rows.column("lang").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([lang, pa.array(step), pa.array(labels.astype(np.int32))], ["lang", "step", "toxic"])

    steps = bundles.mapInArrow(run, "lang string, step int, toxic int").groupBy("lang", "step")
    steps = steps.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("ones"))
    # A language has a row for each step at most.
    language = Window.partitionBy("lang")
    above = language.orderBy(F.desc("step"))
    f1 = 2 * F.sum("ones").over(above) / (F.sum("n").over(above) + F.sum("ones").over(language))
    below = F.coalesce(F.lead("step").over(above) + 1, F.lit(0))
    limit = (F.col("step") + below) / (2 * BINS)
    both = F.sum("ones").over(language).between(1, F.sum("n").over(language) - 1)
    scored = steps.select("lang", f1.alias("f1"), "step", limit.alias("limit"), both.alias("both")).where("both")
    best = scored.groupBy("lang").agg(F.max_by("limit", F.struct("f1", "step")).alias("limit"))
    return {r["lang"]: r["limit"] for r in best.collect()}


def train(
    documents: DataFrame, known: DataFrame, per_class: int | None = None, most_chars: int = 20_000
) -> tuple[WordFilters, dict[str, float]] | None:
    """The classifier and a threshold for each language, from rows (doc_id, text, lang) and labels (doc_id, toxic 0/1).

    Learns from all labelled rows, whole; a fifth, by a hash, is kept back, and there each language
    gets the threshold of best F1. None if a class is missing.

    Only for quick trials, with `per_class`: fits on about so many rows
    of each class (never over twice as many), taken by a hash of doc_id and text, whatever the splits; of a
    text over `most_chars` characters a window at a place taken by a hash. Weights give back each class's
    share of all rows. Labels then meet the keys of documents, and the keys of the sample go to where the texts are.
    """
    if per_class is None:
        return train_whole(documents, known)
    rows = documents.where(F.col("text").isNotNull()).withColumn("key", F.xxhash64("doc_id", "text", F.lit(29)))
    labelled = rows.select("doc_id", "key").join(known.where(F.col("toxic").isin(0, 1)), "doc_id").distinct()
    counts = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (int(k), min(1.0, per_class / n))])
    hashed = F.pmod("key", F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = labelled.where(hashed < share[F.col("toxic").cast("int")]).limit(4 * per_class)
    place = F.pmod(F.xxhash64("key"), F.greatest(F.length("text") - most_chars + 1, F.lit(1)))
    window = F.substring(F.col("text"), (place + 1).cast("int"), F.lit(most_chars)).alias("text")
    sample = rows.join(F.broadcast(chosen), ["doc_id", "key"]).select("key", "lang", "toxic", window)
    schema = "key long, lang string, toxic int, word array<int>, stem array<int>"
    taken = sample.mapInArrow(_sample, schema).limit(4 * per_class).toArrow().sort_by("key")
    labels = taken.column("toxic").to_numpy().astype(np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    weights = np.where(labels == 1, counts[1] / labels.sum(), counts[0] / (1 - labels).sum())
    weights = (weights / weights.mean()).astype(np.float32)
    kept_back = np.arange(len(labels)) % 5 == 0
    model = WordFilters()
    fit = np.flatnonzero(~kept_back)
    model.fit(_chosen(taken, fit), labels[fit], weights[fit])
    test = np.flatnonzero(kept_back)
    scores = model.scores_of(_chosen(taken, test))
    thresholds = {}
    languages = np.array([x or "" for x in taken.column("lang").to_pylist()])[test]
    for name in sorted(set(languages.tolist())):
        own = languages == name
        thresholds[name] = _best_threshold(scores[own], labels[test][own], weights[test][own])
    return model, thresholds


def _best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(-scores, kind="stable")
    s, y, w = scores[order], labels[order], weights[order]
    if not y.any() or y.all():
        return THRESHOLD
    right = np.cumsum(w * y)
    f1 = 2 * right / (np.cumsum(w) + (w * y).sum())
    f1[:-1][s[:-1] == s[1:]] = 0  # a threshold can't part equal scores
    best = int(np.argmax(f1))
    below = s[best + 1] if best + 1 < len(s) else 0.0
    return float((s[best] + below) / 2)


def score_documents(documents: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold (of the row's language), flagged for each document.

    Learns from labelled documents of the other folds only (crc32 of doc_id as text; null counts
    as the empty text). A score depends on the text alone; null and empty texts get the score of
    a text without words. `predicted` is score >= 0.3; `flagged` compares with the threshold
    calibrated for the row's language, or 0.3 where the language was not seen. Labels that
    are null or not 0 or 1 are not learned from; repeated rows and equal labels of a document count once. If there is
    nothing to learn, or one class only, scores are 0. All rows give a row, repeated ones too;
    texts are read whole. Empty tables give no rows; other columns are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn(
        "held_out", crc_fold(F.col("doc_id"), folds) == held
    )
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    learned = train(rows.where(~F.col("held_out")), known)
    model, thresholds = learned or (None, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                scores = model.scores(batch.column("text")) if model else np.zeros(batch.num_rows)
                limits = np.array([thresholds.get(x or "", THRESHOLD) for x in batch.column("lang").to_pylist()], float)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("held_out"),
                        pa.array(scores, pa.float64()),
                        pa.array((scores >= THRESHOLD).astype(np.int32)),
                        pa.array(limits),
                        pa.array(scores >= limits),
                    ],
                    ["doc_id", "held_out", "score", "predicted", "threshold", "flagged"],
                )

    return rows.mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int, threshold double, flagged boolean"
    )
