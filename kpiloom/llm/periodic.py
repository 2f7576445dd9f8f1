"""Periodic runs of words, found by recursive splitting on frequency and a scan over lags.

Every word of a run has a copy one period away inside the run. So a word that occurs once in its
segment is in no run and splits the segment; its parts are judged anew by what occurs in them, until
nothing splits. The same holds for stretches of four words, which cuts what is left further. The
survivors are scanned lag by lag. Long lags are not all tried: a run of period q holds a whole block
of s <= q / 2 words that stands again q words later, so each block asks the sorted places of its own
word sequence for the lags worth a scan.

All documents of a batch lie in one flat array of word numbers, so the scan is a few numpy calls
a batch and its work near linear in the words, also for one very long text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import pieces_of
from kpiloom.llm.flat import text_parts

LEAST = 12  # words of a run at least
SPAN = 4  # words of the sequences that split what single words leave
SHORT = 64  # lags below are all tried, those from here on only where a block repeats
PIECE = 4 << 20  # bytes of text that are worked on together
CHUNK = 1 << 20  # bytes of a text, pairs of blocks and words of an output that are held as objects

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]
RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


# --- words as numbers ----------------------------------------------------------------


def word_numbers(text: bytes, numbers: defaultdict) -> np.ndarray:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as numbers; equal words, and only those, are equal."""
    # bytes.split() without an argument splits at exactly these six characters.
    parts = [np.array(list(map(numbers.__getitem__, part.split())), np.int64) for part in text_parts(text, CHUNK)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


# --- splitting -----------------------------------------------------------------------


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the stretches, one after the other."""
    first = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(begin - first, size)


def _sequences(words: np.ndarray, span: int) -> np.ndarray:
    """A number for the `span` (a power of two) words from each place on."""
    out, built = _dense(words), 1
    while built < span and len(out) > built:
        out = _dense(out[:-built] * (int(out.max()) + 1) + out[built:])
        built *= 2
    return out


def split_rare(
    sequences: np.ndarray, span: int, begin: np.ndarray, end: np.ndarray, least: int = LEAST
) -> tuple[np.ndarray, np.ndarray]:
    """Segments whose words are all covered by a sequence of `span` words that repeats in the segment.

    `sequences` has a number for the `span` words from each place on. Segments that were split are
    judged again by what is left in each part; parts of under `least` words go.
    """
    done: list[tuple[np.ndarray, np.ndarray]] = []
    kinds = int(sequences.max(initial=0)) + 1
    while True:
        fits = end - begin >= least
        begin, end = begin[fits], end[fits]
        if not len(begin):
            break
        size = end - begin
        at, first = _places(begin, size), np.cumsum(size) - size
        fit = np.maximum(size - span + 1, 0)
        whole, segment = _places(begin, fit), np.repeat(np.arange(len(begin)), fit)
        hits = whole[_repeated(segment * kinds + sequences[whole])]
        # A place is covered if one of the `span` places up to it begins a repeated sequence.
        base = int(begin[0])
        opened = np.bincount(hits - base, minlength=int(end[-1]) - base + span + 1)
        opened[span:] -= opened[:-span].copy()
        covered = np.cumsum(opened) > 0
        lost = np.logical_or.reduceat(~covered[at - base], first)
        done.append((begin[~lost], end[~lost]))
        if not lost.any():
            break
        begin, end = begin[lost], end[lost]
        inside = _places(begin, end - begin) - base
        alive = np.zeros(len(covered), bool)
        alive[inside] = covered[inside]
        cut = np.zeros(len(alive) + 1, bool)
        cut[begin - base] = True  # a segment may begin where another ends
        opens = alive & (cut[:-1] | ~np.concatenate([[False], alive[:-1]]))
        closes = alive & (cut[1:] | ~np.concatenate([alive[1:], [False]]))
        begin, end = np.flatnonzero(opens) + base, np.flatnonzero(closes) + 1 + base
    if not done:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begin, end = (np.concatenate([d[i] for d in done]) for i in (0, 1))
    order = np.argsort(begin)
    return begin[order], end[order]


def _apart(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments in one array, a place that equals nothing after each, and each place's origin."""
    size = end - begin + 1
    origin = _places(begin, size)
    out = np.empty(len(origin), np.int64)
    last = np.cumsum(size) - 1
    inside = np.ones(len(origin), bool)
    inside[last] = False
    out[inside] = words[origin[inside]]
    out[last] = -1 - np.arange(len(last))
    return out, origin


# --- scanning ------------------------------------------------------------------------


def _short_lags(words: np.ndarray, longest: int, least: int) -> list[tuple]:
    found = []
    for q in range(1, min(SHORT - 1, longest // 2) + 1):
        same = np.flatnonzero(words[:-q] == words[q:])
        if len(same) < max(q, least - q):
            continue
        breaks = np.flatnonzero(np.diff(same) != 1)
        first = same[np.concatenate([[0], breaks + 1])]
        last = same[np.concatenate([breaks, [len(same) - 1]])]
        length = last - first + 1 + q
        fits = length >= max(least, 2 * q)
        if fits.any():
            found.append((first[fits], length[fits], np.full(int(fits.sum()), q)))
    return found


def _streak(words: np.ndarray, q: int, at: int, size: int) -> tuple[int, int]:
    """How far the words from `at` to `at + size` go on equalling those q later, both ways."""
    end, step = at + size, size
    while end + q < len(words):
        n = min(step, len(words) - q - end)
        differ = words[end : end + n] != words[end + q : end + q + n]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = end + n, 2 * step
    begin, step = at, size
    while begin > 0:
        n = min(step, begin)
        differ = (words[begin - n : begin] != words[begin - n + q : begin + q])[::-1]
        if differ.any():
            begin -= int(differ.argmax())
            break
        begin, step = begin - n, 2 * step
    return begin, end


def _scan_blocks(words: np.ndarray, ranks: np.ndarray, alive: np.ndarray, s: int, known: list[tuple]) -> list[tuple]:
    """Runs of periods from 2 * s to 4 * s - 1, by aligned blocks of s words that stand again."""
    found: list[tuple] = []
    blocks = alive[alive % s == 0]
    if not len(blocks):
        return found
    # Inside a known run of a period of s / 2 or less a block's copies are the run's own multiples,
    # which are no smallest periods: only lags that lead out of the run are asked for.
    reach = np.zeros(len(words) // s + 2, np.int64)
    for first, length, period in known:
        for b, n in zip(first[m := (2 * period <= s) & (length >= s)].tolist(), length[m].tolist(), strict=True):
            reach[-(-b // s) : (b + n - s) // s + 1] = b + n
    low = np.maximum(blocks + 2 * s, reach[blocks // s] - s + 1)
    high = blocks + 4 * s
    width = len(words) + 4 * s
    keys = np.sort(ranks[alive] * width + alive)
    mine = ranks[blocks] * width
    begin, end = np.searchsorted(keys, mine + np.minimum(low, high)), np.searchsorted(keys, mine + high)
    many = end - begin
    blocks, begin, many = blocks[many > 0], begin[many > 0], many[many > 0]
    done: dict[int, int] = {}  # by lag: where its last streak ended
    total = np.cumsum(many)
    for lo in range(0, int(total[-1]) if len(total) else 0, CHUNK):
        # The blocks whose pairs overlap this chunk, their pairs cut to it.
        a, b = np.searchsorted(total, lo, "right"), np.searchsorted(total, lo + CHUNK, "left") + 1
        skip = np.maximum(lo - (total[a:b] - many[a:b]), 0)
        take = np.minimum(total[a:b], lo + CHUNK) - (total[a:b] - many[a:b]) - skip
        at = np.repeat(blocks[a:b], take)
        lag = keys[_places(begin[a:b] + skip, take)] % width - at
        order = np.lexsort((at, lag))
        for q, place in zip(lag[order].tolist(), at[order].tolist(), strict=True):
            if place < done.get(q, 0):
                continue
            first, last = _streak(words, q, place, s)
            done[q] = last
            if last - first >= q:
                found.append((first, last - first + q, q))
    if not found:
        return []
    return [tuple(np.array(x, np.int64) for x in zip(*found, strict=True))]


def _long_lags(words: np.ndarray, longest: int, known: list[tuple]) -> list[tuple]:
    """Runs of periods of SHORT and more. Ranks tell equal sequences of 1, 2, 4, … words apart."""
    found: list[tuple] = []
    ranks = _dense(words)
    alive = np.flatnonzero(_repeated(ranks))
    s = 1
    while len(alive) and 4 * s <= longest:
        if 2 * s >= SHORT:
            found += _scan_blocks(words, ranks, alive, s, known + found)
        both = alive[:-1] if len(alive) and alive[-1] + s >= len(words) else alive
        both = both[both + s < len(words)]
        live = np.zeros(len(words), bool)
        live[alive] = True
        both = both[live[both + s]]  # a sequence that repeats has two halves that do
        longer = _dense(ranks[both] * (int(ranks.max(initial=0)) + 1) + ranks[both + s])
        again = _repeated(longer)
        alive = both[again]
        ranks = np.full(len(words), -1, np.int64)
        ranks[alive] = longer[again]
        s *= 2
    return found


def _smallest(found: list[tuple]) -> Runs:
    """The runs once each: multiples of a period span the same places, the smallest is the period."""
    if not found:
        return (np.empty(0, np.int64),) * 3
    first, length, period = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((period, length, first))
    first, length, period = first[order], length[order], period[order]
    new = np.ones(len(first), bool)
    new[1:] = (np.diff(first) != 0) | (np.diff(length) != 0)
    return first[new], length[new], period[new]


def find_runs(words: np.ndarray, counts: np.ndarray, least: int = LEAST) -> Runs:
    """Start, length and smallest period of every run in the sequences, by start and period.

    `words` holds the sequences of `counts` numbers one after the other; starts are places in it. A run has
    at least `least` places and two periods, no neighbour extends it, and it lies in one sequence.
    """
    none = np.empty(0, np.int64)
    end = np.cumsum(counts)
    begin, end = split_rare(words, 1, end - counts, end, least)
    if not len(begin):
        return none, none, none
    flat, origin = _apart(words, begin, end)
    if least >= 2 * SPAN:
        # At lag q a run matches itself at least / 2 or more places on end, so each of its words
        # lies in a sequence of SPAN words that repeats.
        size = end - begin
        begin = np.cumsum(size + 1) - (size + 1)
        begin, end = split_rare(_sequences(flat, SPAN), SPAN, begin, begin + size, least)
        if not len(begin):
            return none, none, none
        flat, within = _apart(flat, begin, end)
        origin = origin[within]
    longest = int((end - begin).max())
    found = _smallest(_short_lags(flat, longest, least))
    if longest >= 2 * SHORT:
        found = _smallest([found, *_long_lags(flat, longest, [found])])
    first, length, period = found
    first = origin[first]
    order = np.lexsort((period, first))
    return first[order], length[order], period[order]


# --- documents -----------------------------------------------------------------------


def _joined(numbers: np.ndarray, names: list[bytes]) -> bytes:
    parts = (
        b" ".join(map(names.__getitem__, numbers[i : i + CHUNK].tolist())) for i in range(0, len(numbers), CHUNK)
    )
    return b" ".join(parts)


def periodic_runs(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    rewritten: Callable[[int, int], tuple[int, int] | None] | None = None,
) -> DataFrame:
    """For each row of `documents`: the key, n_words, n_runs, runs (array of start, length, period) and collapsed.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A run is a stretch of consecutive words with smallest
    period q and at least `least` words and two periods that no neighbouring word extends; runs are
    ordered by start, then period. `collapsed` is the text with the first period of each run
    left: a word goes if any run holds it after that run's first q words; the rest is joined by one space.

    `rewritten` may name, for a key and a number of words, a pair (a, p): each word i >= a is first
    replaced by word a + (i - a) % p of the text as it was. None leaves the text alone.

    Null and empty texts have no words, no runs and an empty `collapsed`. Texts are taken whole, each by
    itself: repeated rows give repeated results, a null key is never rewritten. An empty table gives
    no rows; other columns are not read. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text", PIECE):
                yield _of_batch(batch, least, rewritten)

    docs = documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    schema = "key long, n_words long, n_runs long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.mapInArrow(run, schema).withColumnRenamed("key", key)


def _of_batch(batch: pa.RecordBatch, least: int, rewritten: Callable | None) -> pa.RecordBatch:
    numbers: defaultdict = defaultdict(count().__next__)
    texts = batch.column("text").cast(pa.binary())
    each = []
    for key, text in zip(batch.column("key").to_pylist(), texts, strict=True):
        words = word_numbers(text.as_py() or b"", numbers)
        if rewritten and key is not None and len(words) and (how := rewritten(key, len(words))):
            a, p = how
            words[a:] = words[a + np.arange(len(words) - a) % p]
        each.append(words)
    counts = np.array([len(w) for w in each], np.int64)
    flat = np.concatenate(each) if each else np.empty(0, np.int64)
    del each
    start, length, period = find_runs(flat, counts, least)
    begin = np.cumsum(counts) - counts
    owner = np.searchsorted(begin + counts, start, "right")
    many = np.bincount(owner, minlength=len(counts))
    gone = np.bincount(start + period, minlength=len(flat) + 1) - np.bincount(start + length, minlength=len(flat) + 1)
    stays = np.cumsum(gone[:-1]) == 0
    names = list(numbers)
    kept = [_joined(flat[b : b + n][stays[b : b + n]], names) for b, n in zip(begin.tolist(), counts.tolist(), strict=True)]
    offsets = pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32())
    values = pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in (start - begin[owner], length, period)], ["start", "length", "period"]
    )
    return pa.RecordBatch.from_arrays(
        [
            batch.column("key"),
            pa.array(counts, pa.int64()),
            pa.array(many, pa.int64()),
            pa.ListArray.from_arrays(offsets, values).cast(RUNS),
            pc.cast(pa.array(kept, pa.binary()), pa.string(), safe=False),
        ],
        ["key", "n_words", "n_runs", "runs", "collapsed"],
    )
