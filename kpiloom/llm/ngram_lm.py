"""Language-model scores from an n-gram trie in Elias-Fano form.

The trie is cut into shards by the hash of the context. In a shard a level holds, in mapped
files: the contexts, a monotone sequence of pointers to each context's successors, the
successors, relative to their context, and quantised smoothed probabilities. Documents are
worked off in batches: a batch asks for each n-gram once, the shards learn from the counts of all
batches and answer all that was asked, and the batch adds up its documents. This goes in rounds over
levels and shards, so that only what one round asks is on disk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import crc_fold, pieces_of, with_row_id
from kpiloom.llm.elias_fano import EliasFano, mapped
from kpiloom.llm.flat import chain, span_hashes, words_of
from kpiloom.session import cut_lineage

ORDER = 2
DISCOUNT = 0.75
SHARD_CHARS = 12_000_000  # text whose n-grams one shard takes, on average
# Texts of up to so many bytes come in batches of up to 2**n rows, longer ones by themselves: large
# batches ask for fewer n-grams in all, and none holds more than 32 MB of text, or one text.
BATCHES = ((4_096, 12), (16_384, 11), (65_536, 9), (1 << 20, 5))
BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6BC2B2AE35)  # any two numbers
LEAST_LOG = -12.0
TOP = 65_535


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit code of a probability: 0 for none, else log10 in even steps from -12 to 0."""
    with np.errstate(divide="ignore"):
        steps = np.rint((np.log10(p) - LEAST_LOG) / -LEAST_LOG * (TOP - 1)) + 1
    return np.where(p > 0, np.clip(steps, 1, TOP), 0).astype(np.uint16)


def packed(values: np.ndarray) -> bytes:
    """Small numbers, compressed, in the narrowest type that holds them, named by the first byte."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + zstandard.compress(values.astype(kind).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw[1:]), f"u{raw[0]}").astype(np.int64)


def packed_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit hashes as differences, byte by byte of their places: the first bytes are zeros and vanish."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked_sorted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def restore(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((code.astype(np.float64) - 1) / (TOP - 1) * -LEAST_LOG + LEAST_LOG), 0.0)


class Level:
    """Successors of contexts with probabilities, from counts sorted by context and successor.

    contexts: distinct sorted uint64; sizes: successors of each; successors: uint32, sorted within a
    context; counts: how often each was seen (over 0). `seen` holds the discounted share of each
    successor in its context, `rest` the weight that a context leaves to shorter ones.
    """

    def __init__(self, contexts: np.ndarray, sizes: np.ndarray, successors: np.ndarray, counts: np.ndarray):
        begin = np.cumsum(sizes) - sizes
        total = np.add.reduceat(counts, begin) if len(sizes) else np.empty(0)
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
        share = (counts - DISCOUNT) / total[owner.astype(np.int64)]
        self.contexts = EliasFano(contexts, 1 << 64)
        self.pointers = EliasFano(np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64), len(successors) + 1)
        self.successors = EliasFano((owner << np.uint64(32)) | successors, max(len(sizes), 1) << 32)
        codes = quantise(share), quantise(DISCOUNT * sizes / np.maximum(total, 1))
        parts = [self.contexts, self.pointers, self.successors]
        arrays = mapped([a for part in parts for a in (part.field, part.low)] + list(codes))
        for k, part in enumerate(parts):
            part.field, part.low = arrays[2 * k], arrays[2 * k + 1]
        self.seen, self.rest = arrays[-2], arrays[-1]

    def answer(self, contexts: np.ndarray, sizes: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes for each successor asked for (0 if not seen), and of what each context leaves."""
        place = self.contexts.find(contexts)
        known = place >= 0
        rest = np.full(len(contexts), TOP, np.uint16)
        rest[known] = self.rest[place[known]]
        first, last = np.zeros((2, len(contexts)), np.int64)
        first[known] = self.pointers.get(place[known]).astype(np.int64)
        last[known] = self.pointers.get(place[known] + 1).astype(np.int64)
        asked = np.repeat(known, sizes)
        seen = np.zeros(len(successors), np.uint16)
        value = (np.repeat(place, sizes)[asked].astype(np.uint64) << np.uint64(32)) | successors[asked]
        at = self.successors.find(value, np.repeat(first, sizes)[asked], np.repeat(last, sizes)[asked])
        seen[asked] = np.where(at >= 0, self.seen[at], 0)
        return seen, rest


class Batch:
    """Tokens of some texts: a hash for each word, then one end for each text."""

    def __init__(self, texts: pa.Array):
        ids, counts = [], []
        whole = pa.RecordBatch.from_arrays([texts], ["text"])
        for part in pieces_of(whole, "text"):
            words = words_of(part.column("text"), lower=True)
            ids.append(span_hashes(words.data, words.start, words.end))
            counts.append(words.count)
        count = np.concatenate(counts) if counts else np.empty(0, np.int64)
        self.count = count + 1
        self.owner = np.repeat(np.arange(len(count)), self.count)
        self.ids = np.full(len(self.owner), END, np.uint64)
        ends = np.cumsum(self.count) - 1
        words_at = np.ones(len(self.owner), bool)
        words_at[ends] = False
        if ids:
            self.ids[words_at] = np.concatenate(ids)

    def context(self, order: int) -> np.ndarray:
        """Hash of the order - 1 tokens before each token; before the first come begins."""
        first = np.cumsum(self.count) - self.count
        back = self.ids
        out = None
        for _ in range(order - 1):
            back = np.concatenate([[BEGIN], back[:-1]])
            back[first] = BEGIN
            out = back if out is None else chain(back, out)
        return out

    def unigrams(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.ids, return_inverse=True)

    def grams(
        self, context: np.ndarray, tokens: np.ndarray | slice = slice(None)
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts, successors of each, successors, and where each of the tokens is in the two lists."""
        contexts, of_context = np.unique(context[tokens], return_inverse=True)
        ids = self.ids[tokens] >> np.uint64(32)
        keys, of_key = np.unique((of_context.astype(np.uint64) << np.uint64(32)) | ids, return_inverse=True)
        sizes = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(contexts))
        return contexts, sizes, (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), of_context, of_key


def _edges(shards: int) -> np.ndarray:
    """Where each shard's range of hashes begins."""
    return np.array([(k << 64) // shards for k in range(shards)], np.uint64)


def _rounds(shards: int, order: int) -> list[list[tuple[int, int, int]]]:
    """Level, first and last shard (exclusive) of what is asked at once.

    Words and their pairs go together, each longer level in two halves: a text has nearly as many
    distinct triples as words, and each of them takes twice the bytes of a pair.
    """
    halves = [(0, shards // 2), (shards // 2, shards)]
    longer = [[(level, *half)] for level in range(3, order + 1) for half in halves if half[0] < half[1]]
    return [[(1, 0, shards), (2, 0, shards)], *longer]


ASKED = "level int, shard int, batch long, contexts binary, sizes binary, successors binary, counts binary"
ANSWERED = "level int, shard int, batch long, seen binary, rest binary, tokens long, words long"


def _ask(shards: int, parts: list[tuple[int, int, int]]):
    """Each batch's distinct n-grams of some levels and shards, with their counts in training texts, cut into shards."""
    edges = _edges(shards)

    def of_batch(number: int, texts: pa.Array, training: np.ndarray) -> Iterator[pa.RecordBatch]:
        batch = Batch(texts)
        train = training[batch.owner].astype(np.float64)
        rows = []
        for level, first, last in parts:
            tokens = slice(None)
            if level == 1:
                contexts, of_key = batch.unigrams()
                sizes, successors = np.ones(len(contexts), np.int64), np.empty(0, np.uint32)
            else:
                context = batch.context(level)
                if first > 0 or last < shards:
                    tokens = context >= edges[first]
                    if last < shards:
                        tokens &= context < edges[last]
                contexts, sizes, successors, _, of_key = batch.grams(context, tokens)
            counts = np.bincount(of_key, weights=train[tokens], minlength=int(sizes.sum())).astype(np.uint32)
            cut = np.append(np.searchsorted(contexts, edges[first:last]), len(contexts))
            inner = np.concatenate([[0], np.cumsum(sizes)])[cut]
            for s, a, b, c, d in zip(range(first, last), cut, cut[1:], inner, inner[1:], strict=False):
                if a < b:
                    rows.append(
                        (level, s, number, packed_sorted(contexts[a:b]), b"" if level == 1 else packed(sizes[a:b]),
                         successors[c:d].tobytes(), packed(counts[c:d]))
                    )
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
        names = ["level", "shard", "batch", "contexts", "sizes", "successors", "counts"]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(bundles: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in bundles:
            for number, blob in zip(some.column("_batch").to_pylist(), some.column("rows"), strict=True):
                rows = _unbundled(blob.as_buffer())
                training = ~rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                yield from of_batch(number, rows.column("text").chunk(0), training)

    return run


def _answer(shard: pa.Table) -> pa.Table:
    """Learn one shard of one level from all batches, and answer what each of them asked."""
    level, number = shard.column("level")[0].as_py(), shard.column("shard")[0].as_py()

    def all_of(name: str, read=unpacked) -> tuple[np.ndarray, np.ndarray]:
        parts = [read(x) for x in shard.column(name).to_pylist()]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    contexts, cut = all_of("contexts", unpacked_sorted)
    counts, inner = all_of("counts")
    distinct, of_context = np.unique(contexts, return_inverse=True)
    if level == 1:
        total = np.bincount(of_context, weights=counts, minlength=len(distinct)).astype(np.int64)
        asked = total[of_context]
        answers = [(packed(asked[a:b]), b"") for a, b in zip(cut, cut[1:], strict=False)]
        tokens, words = int(total.sum()), int((total > 0).sum())
    else:
        sizes, _ = all_of("sizes")
        successors, _ = all_of("successors", lambda x: np.frombuffer(x, np.uint32))
        keys = (np.repeat(of_context, sizes).astype(np.uint64) << np.uint64(32)) | successors
        # What several batches ask is looked up once.
        keys, of_key = np.unique(keys, return_inverse=True)
        owner, successors = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        total = np.bincount(of_key, weights=counts, minlength=len(keys))
        some = total > 0
        of_learned, per = np.unique(owner[some], return_counts=True)
        trie = Level(distinct[of_learned], per, successors[some], total[some])
        seen, rest = trie.answer(distinct, np.bincount(owner, minlength=len(distinct)), successors)
        answers = [
            (packed(seen[of_key[c:d]]), packed(rest[of_context[a:b]]))
            for a, b, c, d in zip(cut, cut[1:], inner, inner[1:], strict=False)
        ]
        tokens = words = 0
    n = len(answers)
    # One more row, of batch -1, says how much the shard has learned.
    return pa.table(
        {
            "level": pa.array([level] * (n + 1), pa.int32()),
            "shard": pa.array([number] * (n + 1), pa.int32()),
            "batch": pa.array([*shard.column("batch").to_pylist(), -1], pa.int64()),
            "seen": pa.array([*(a for a, _ in answers), b""], pa.binary()),
            "rest": pa.array([*(b for _, b in answers), b""], pa.binary()),
            "tokens": pa.array([0] * n + [tokens], pa.int64()),
            "words": pa.array([0] * n + [words], pa.int64()),
        }
    )


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each batch as one compressed value: texts move in a third of their size."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))
    open_: dict[int, list[pa.RecordBatch]] = {}
    group = None

    def close() -> Iterator[pa.RecordBatch]:
        for number, parts in open_.items():
            rows = pa.Table.from_batches(parts).select(["doc_id", "held_out", "text"]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_table(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["_batch", "rows"]
            )
        open_.clear()

    for rows in batches:
        # Batches are runs of row keys, so one that is left behind never comes again.
        groups = rows.column("_row").to_numpy() >> BATCHES[0][1]
        numbers = rows.column("_batch").to_numpy()
        for g in dict.fromkeys(groups.tolist()):
            if g != group:
                yield from close()
                group = g
            for number in np.unique(numbers[groups == g]).tolist():
                mine = np.flatnonzero((numbers == number) & (groups == g))
                open_.setdefault(number, []).append(rows.take(pa.array(mine)))
    yield from close()


def _unbundled(blob: bytes | pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(tokens: int, words: int, order: int):
    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        documents = _unbundled(documents.column("rows")[0].as_buffer())
        batch = Batch(documents.column("text").chunk(0))
        answers = answers.sort_by([("level", "ascending"), ("shard", "ascending")])
        levels = answers.column("level").to_numpy()

        def joined(level: int, name: str) -> np.ndarray:
            parts = answers.column(name).take(pa.array(np.flatnonzero(levels == level))).to_pylist()
            return np.concatenate([unpacked(x) for x in parts])

        counts = joined(1, "seen")[batch.unigrams()[1]]
        p = (counts + 0.5) / (tokens + 0.5 * (words + 1))
        n = len(batch.count)

        def per_text(x: np.ndarray) -> np.ndarray:
            return np.bincount(batch.owner, weights=x, minlength=n)

        base, known = per_text(np.log10(p)), per_text(counts > 0)
        for level in range(2, order + 1):
            *_, of_context, of_key = batch.grams(batch.context(level))
            p = restore(joined(level, "seen")[of_key]) + restore(joined(level, "rest")[of_context]) * p
        return pa.table(
            {
                "doc_id": documents.column("doc_id"),
                "held_out": documents.column("held_out"),
                "n_tokens": pa.array(batch.count.astype(np.int64)),
                "n_known": pa.array(known.astype(np.int64)),
                "train_tokens": pa.array(np.full(n, tokens, np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(per_text(np.log10(p))),
            }
        )

    return run


def batch_number() -> Column:
    """The batch of a row, by its key and the size of its text."""
    kinds = len(BATCHES) + 1
    number = F.col("_row") * kinds
    for kind, (most, bits) in reversed([*enumerate(BATCHES, 1)]):
        number = F.when(F.octet_length("text") <= most, F.shiftright("_row", bits) * kinds + kind).otherwise(number)
    return number


def score_documents(documents: DataFrame, held_out: Column, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Learns from the rows that are not held out, all of them and whole. Tokens are words
    `[^\\x20\\x09-\\x0D]+` in lower case (A-Z only), then one end. `base_score` adds up
    log10((c + 0.5) / (N + 0.5 * (V + 1))); `score` does so for the n-gram model of `order`: absolute
    discounting, interpolated down to that base. Shares and left-over weights are 16-bit codes.
    Words are known by 64-bit hashes; a context's successors by 32 bits, which need be apart
    within that context only.

    Null and empty texts are one end. Repeated rows each count and each give a row. A null
    doc_id passes through. If nothing is learned, all words score alike. An empty table gives no
    rows; other columns are not read.
    """
    if order < 2:
        raise ValueError("the model needs n-grams of two words or more")
    rows = with_row_id(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
            F.coalesce(held_out, F.lit(False)).alias("held_out"),
        )
    )
    rows = rows.withColumn("_batch", batch_number())
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // SHARD_CHARS))
    # Asked and scored from what is written once: a second plan over the files may cut them into other batches.
    bundles = cut_lineage(rows.mapInArrow(_bundled, "_batch long, rows binary"))
    # Each round's requests leave the disks before the next round writes its own.
    answers = reduce(
        DataFrame.unionAll,
        [
            cut_lineage(
                bundles.mapInArrow(_ask(shards, parts), ASKED).groupBy("level", "shard").applyInArrow(_answer, ANSWERED),
                drop_shuffles=True,
            )
            for parts in _rounds(shards, order)
        ],
    )
    tokens, words = answers.where("batch = -1").agg(F.sum("tokens"), F.sum("words")).first()
    return (
        bundles.groupBy("_batch")
        .cogroup(answers.where("batch <> -1").withColumnRenamed("batch", "_batch").groupBy("_batch"))
        .applyInArrow(_score(tokens or 0, words or 0, order), SCORED)
    )


def held_out_fold(doc_id: Column, folds: int = 5, held: int = 1) -> Column:
    return crc_fold(doc_id, folds) == held
