"""Substring dedup: passages of many words that already stood in an earlier document.

Every window of LENGTH words holds an anchor, a run of ANCHOR words that winnowing picks by its
hash, and equal windows hold anchors of equal hash. So a window can only repeat where an anchor
does. Passages around anchors that occur in several documents go to the shard of the anchor's
hash, equal passages once. Each shard builds a compressed FM-index over its passages and streams
them through it: backward search gives the matches of every window of LENGTH words,
and the least doc_id among them says whether an earlier document has it. Anchors too frequent for
one shard are cut by their windows instead: each distinct window's least doc_id is an aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import pieces_of, with_row_id
from kpiloom.llm.flat import Words, chain, gram_hashes, span_hashes, words_of
from kpiloom.llm.fm_index import FMIndex, least_in

LENGTH = 50
ANCHOR = 10
# Bits of the filter that tells tasks which anchors repeat: a fixed 4 MB at most, whatever the
# input. Where it says yes wrongly, a passage is looked up in vain; it never says no wrongly.
FILTER_BITS = 25
# Passages of one shard, on average: what one task indexes at a time. An anchor that occurs more often goes to none.
SHARD_PASSAGES = 16_384
NO_DOC = np.iinfo(np.int64).max


def _least_ahead(values: np.ndarray, count: int) -> np.ndarray:
    """Minimum of each `count` neighbours."""
    out, built = values, 1
    while built * 2 <= count:
        out = np.minimum(out[: len(out) - built], out[built:])
        built *= 2
    rest = count - built
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors_of(hashes: np.ndarray, count: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors in texts whose word hashes stand in a row.

    Of each length - anchor + 1 neighbouring hashes the smallest is an anchor. Where one hash is the
    smallest again and again (words that repeat), only as many of its places are kept as every
    window needs.
    """
    span = length - anchor + 1
    grams = gram_hashes(hashes, anchor) if len(hashes) >= anchor else np.empty(0, np.uint64)
    if len(grams) < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = _least_ahead(grams, span)
    owner = np.repeat(np.arange(len(count)), count)
    inside = owner[: len(least)] == owner[length - 1 :]
    # A gram is taken if it equals the least of a window that holds it: mark by the largest
    # least over the windows that end at it or before, which only whole windows take part in.
    marks = np.where(inside, least, 0)
    padded = np.concatenate([np.zeros(span - 1, np.uint64), marks, np.zeros(span - 1, np.uint64)])
    most = ~_least_ahead(~padded, span)
    places = np.flatnonzero(most == grams)
    return _thin(places, grams[places], span)


def _thin(places: np.ndarray, hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    close = (hashes[1:] == hashes[:-1]) & (np.diff(places) <= span)
    if not close.any():
        return places, hashes
    keep = np.ones(len(places), bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], close.view(np.int8), [0]])))
    for first, last in edges.reshape(-1, 2).tolist():
        run = places[first : last + 1]
        at = 0
        keep[first : last + 1] = False
        keep[first] = keep[last] = True
        while run[at] + span < run[-1]:
            at = int(np.searchsorted(run, run[at] + span, side="right")) - 1
            keep[first + at] = True
    return places[keep], hashes[keep]


def _word_hashes(texts: pa.Array) -> tuple[Words, np.ndarray]:
    words = words_of(texts)
    return words, span_hashes(words.data, words.start, words.end)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces_of(whole, "text"):
            words, hashes = _word_hashes(batch.column("text"))
            places, found = anchors_of(hashes, words.count)
            owner = np.repeat(np.arange(batch.num_rows), words.count)[places]
            doc_id = batch.column("doc_id").to_numpy(zero_copy_only=False)[owner]
            pairs = np.rec.fromarrays([found.view(np.int64), doc_id.astype(np.int64)], names="anchor,doc_id")
            pairs, n = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.anchor), pa.array(pairs.doc_id), pa.array(n)], ["anchor", "doc_id", "n"])


def _slots(anchor):
    """Two places in the filter for an anchor: the number of a 64-bit word and a bit in it."""
    return [(F.shiftrightunsigned(anchor, s).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))) for s in (0, 32)]


def _repeated_filter(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Filters, as 64-bit words, of the anchors under different doc_ids and of those too frequent for a shard.

    Also how many passages pass the first one: those of its anchors, and of the others as many as
    its share of set bits lets through.
    """
    seen = docs.select("doc_id", "text").mapInArrow(_anchor_rows, "anchor long, doc_id long, n long")
    anchors = seen.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum("n").alias("n"))
    slots = F.when(F.col("a") < F.col("b"), F.array(*_slots(F.col("anchor"))))
    bits = anchors.select("n", F.explode_outer(slots).alias("bit"))
    mask = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    words = (
        bits.select("n", F.shiftright("bit", 6).alias("word"), mask.alias("mask"))
        .groupBy("word")
        .agg(
            F.bit_or("mask").alias("mask"),
            F.bit_or(F.when(F.col("n") > SHARD_PASSAGES, F.col("mask"))).alias("hot"),
            F.sum("n").alias("n"),
        )
        .toArrow()
    )
    # The row without a word counts the anchors of one doc_id.
    single = sum(words.filter(pc.is_null(words.column("word"))).column("n").to_pylist())
    words = words.filter(pc.is_valid(words.column("word")))
    repeated, hot = np.zeros((2, 1 << (FILTER_BITS - 6)), np.uint64)
    at = words.column("word").to_numpy()
    repeated[at] = words.column("mask").to_numpy().view(np.uint64)
    hot[at] = pc.fill_null(words.column("hot"), 0).to_numpy().view(np.uint64)
    share = int(np.bitwise_count(repeated).sum()) / (1 << FILTER_BITS)
    total = int(words.column("n").to_numpy().sum()) // 2 + int(single * share**2)
    return repeated, hot, total


def _maybe(words: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    yes = np.ones(len(anchors), bool)
    for s in (0, 32):
        bit = (anchors >> np.uint64(s)) & np.uint64((1 << FILTER_BITS) - 1)
        yes &= (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return yes


def _passages(docs: DataFrame, repeated: np.ndarray, hot: np.ndarray) -> DataFrame:
    """_row, doc_id, begin, anchor, passage (a hash of its words), hot, words (null if the batch had it before)."""
    shared = docs.sparkSession.sparkContext.broadcast((repeated, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                words, hashes = _word_hashes(batch.column("text"))
                places, found = anchors_of(hashes, words.count)
                some = _maybe(shared.value[0], found)
                places, found = places[some], found[some]
                owner = np.repeat(np.arange(batch.num_rows), words.count)[places]
                first = words.first
                begin = np.maximum(first[owner], places + ANCHOR - LENGTH)
                end = np.minimum(first[owner + 1], places + LENGTH)
                # The passage's name chains hashes of overlapping runs that cover it, and its size.
                name = (end - begin).astype(np.uint64)
                runs = gram_hashes(hashes, ANCHOR) if len(places) else hashes
                for step in range(0, 2 * LENGTH, ANCHOR):
                    at = np.minimum(begin + step, end - ANCHOR)
                    name = chain(name, runs[at])
                pairs = np.rec.fromarrays([found, name], names="a,b")
                new = np.zeros(len(pairs), bool)
                new[np.unique(pairs, return_index=True)[1]] = True
                spans = [hashes[a:b].tobytes() if n else None for a, b, n in zip(begin, end, new, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_row").take(pa.array(owner)),
                        batch.column("doc_id").take(pa.array(owner)),
                        pa.array((begin - first[owner]).astype(np.int32)),
                        pa.array(found.view(np.int64)),
                        pa.array(name.view(np.int64)),
                        pa.array(_maybe(shared.value[1], found)),
                        pa.array(spans, pa.binary()),
                    ],
                    ["_row", "doc_id", "begin", "anchor", "passage", "hot", "words"],
                )

    return docs.mapInArrow(run, "_row long, doc_id long, begin int, anchor long, passage long, hot boolean, words binary")


def index_passages(spans: list[bytes]) -> tuple[FMIndex, np.ndarray, np.ndarray, np.ndarray]:
    """FM-index over passages of word hashes; owner of each place, passages right-aligned, sizes."""
    sizes = np.array([len(s) // 8 for s in spans], np.int64)
    flat = np.frombuffer(b"".join(spans), np.uint64)
    distinct, symbol = np.unique(flat, return_inverse=True)
    symbol = symbol.astype(np.int64) + 1
    owner = np.repeat(np.arange(len(spans)), sizes)
    ends = np.cumsum(sizes)
    text = np.zeros(len(flat) + len(spans), np.int64)
    text[np.arange(len(flat)) + owner] = symbol
    of_place = np.repeat(np.arange(len(spans)), sizes + 1)
    width = int(sizes.max(initial=0))
    aligned = np.zeros((len(spans), width), np.int64)
    aligned[owner, width - (ends[owner] - np.arange(len(flat)))] = symbol
    return FMIndex(text, len(distinct) + 1, LENGTH), of_place, aligned, sizes


def _search_shard(shard: pa.Table) -> pa.Table:
    """For each passage, the least doc_id that has each of its windows; in parts of bounded size."""
    index, of_place, aligned, sizes = index_passages(shard.column("words").to_pylist())
    least = shard.column("least").to_numpy()
    values = least[of_place][index.order]
    firsts = []
    for i in range(0, len(sizes), 8192):
        part = slice(i, i + 8192)
        firsts.append(least_in(index.windows(aligned[part], sizes[part]), values, NO_DOC)[:, ::-1])
    table = np.concatenate(firsts)
    windows = np.maximum(sizes - LENGTH + 1, 0)
    lists = [table[i, table.shape[1] - w :] if w else table[i, :0] for i, w in enumerate(windows)]
    return pa.table(
        {
            "anchor": shard.column("anchor"),
            "passage": shard.column("passage"),
            "firsts": pa.array(lists, pa.list_(pa.int64())),
        }
    )


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each window of some passages."""
    for batch in batches:
        spans = batch.column("words").to_pylist()
        count = np.array([len(s) // 8 for s in spans], np.int64)
        grams = gram_hashes(np.frombuffer(b"".join(spans), np.uint64), LENGTH) if count.sum() >= LENGTH else np.empty(0, np.uint64)
        windows = np.maximum(count - LENGTH + 1, 0)
        begin = np.cumsum(count) - count
        shift = np.cumsum(windows) - windows
        at = np.arange(int(windows.sum())) + np.repeat(begin - shift, windows)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("anchor"),
                batch.column("passage"),
                batch.column("least"),
                pa.ListArray.from_arrays(
                    pa.array(np.append(shift, windows.sum()).astype(np.int32)), pa.array(grams[at].view(np.int64))
                ),
            ],
            ["anchor", "passage", "least", "windows"],
        )


def _hot_firsts(hot: DataFrame) -> DataFrame:
    """anchor, passage, firsts as `_search_shard` gives them, for passages of any number under one anchor.

    A passage has a row with its own least doc_id at each window and, where another passage
    has one of its windows under a smaller one, a second row that says so.
    """
    cut = hot.mapInArrow(_window_rows, "anchor long, passage long, least long, windows array<bigint>")
    each = cut.select("anchor", "passage", "least", F.size("windows").alias("size"), F.posexplode("windows").alias("at", "window"))
    shared = (
        each.groupBy("anchor", "window").agg(F.min("least").alias("first"), F.max("least").alias("last")).where("first < last")
    )
    lower = (
        each.join(shared.drop("last"), ["anchor", "window"])
        .where("first < least")
        .groupBy("anchor", "passage")
        .agg(F.first("least").alias("least"), F.first("size").alias("size"), F.map_from_entries(F.collect_list(F.struct("at", "first"))).alias("of"))
    )
    places = F.sequence(F.lit(0), F.col("size") - 1)
    own = cut.select("anchor", "passage", F.array_repeat("least", F.size("windows")).alias("firsts"))
    return own.union(
        lower.select("anchor", "passage", F.transform(places, lambda i: F.coalesce(F.try_element_at("of", i), "least")).alias("firsts"))
    )


def _removed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of words that windows with an earlier document cover."""
    for batch in batches:
        firsts = batch.column("firsts")
        flat = firsts.flatten().to_numpy()
        sizes = firsts.value_lengths().to_numpy()
        owner = np.repeat(np.arange(batch.num_rows), sizes)
        begins = np.cumsum(sizes) - sizes
        doc_id = batch.column("doc_id").to_numpy()
        hit = np.flatnonzero(flat < doc_id[owner])
        opens = np.ones(len(hit), bool)
        opens[1:] = (np.diff(hit) > 1) | (np.diff(owner[hit]) > 0)
        first = hit[opens]
        last = hit[np.append(opens[1:], True)] if len(hit) else hit
        who = owner[first]
        at = batch.column("begin").to_numpy()[who] - begins[who]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_row").take(pa.array(who)),
                pa.array((first + at).astype(np.int32)),
                pa.array((last + at + LENGTH).astype(np.int32)),
            ],
            ["_row", "first", "last"],
        )


def repeated_runs(docs: DataFrame) -> DataFrame:
    """_row, runs: an array of (first, last exclusive) words to remove, for rows that have any."""
    known = docs.where("doc_id is not null")
    repeated, hot, total = _repeated_filter(known)
    # Read twice below, and cheaper to cut out of the texts again than to write down.
    found = _passages(known, repeated, hot)
    distinct = found.groupBy("anchor", "passage").agg(
        F.min("doc_id").alias("least"), F.bool_or("hot").alias("hot"), F.first("words", ignorenulls=True).alias("words")
    )
    shards = max(1, -(-total // SHARD_PASSAGES))
    firsts = (
        distinct.where(~F.col("hot"))
        .withColumn("shard", F.pmod(F.xxhash64("anchor", F.lit(3)), F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInArrow(_search_shard, "anchor long, passage long, firsts array<bigint>")
    )
    if hot.any():
        firsts = firsts.union(_hot_firsts(distinct.where("hot")))
    at = found.select("_row", "doc_id", "begin", "anchor", "passage")
    hits = at.join(firsts, ["anchor", "passage"]).select("_row", "doc_id", "begin", "firsts")
    runs = hits.mapInArrow(_removed_runs, "_row long, first int, last int")
    return runs.groupBy("_row").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def remove_repeats(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """For each row of `documents`: _row, doc_id, n_words, n_removed, kept_sha256, kept (text), columns `keep`.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if a window of 50 words around it also
    starts in a document of smaller doc_id; windows are judged on the input. `kept` is the text
    itself if nothing goes, else the words that stay, joined by one space.

    Null and empty texts have no words; texts under 50 words lose nothing. Rows with a null
    doc_id neither lose words nor take any. Rows of equal doc_id do not take from each other.
    Texts are taken whole. An empty table gives no rows; other columns are not read.
    """
    keep = keep or []
    docs = with_row_id(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep))
    runs = repeated_runs(docs.select("_row", "doc_id", "text"))
    joined = docs.join(runs, "_row", "left")
    schema = docs.select("_row", "doc_id", *keep).schema
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string"), ("kept", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                n_words, n_removed, digests, kept = [], [], [], []
                for text, cuts in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    left = words
                    if cuts:
                        gone = np.zeros(len(words) + 1, np.int64)
                        for cut in cuts:
                            gone[cut["first"]] += 1
                            gone[cut["last"]] -= 1
                        left = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
                    joined_words = b" ".join(left)
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(left))
                    digests.append(hashlib.sha256(joined_words).hexdigest())
                    kept.append(text if len(left) == len(words) else joined_words.decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ["_row", "doc_id", *keep]),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_removed, pa.int64()),
                        pa.array(digests, pa.string()),
                        pa.array(kept, pa.string()),
                    ],
                    ["_row", "doc_id", *keep, "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return joined.mapInArrow(run, schema)
