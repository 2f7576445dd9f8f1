"""Words of a column of texts as flat numpy arrays, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

# ASCII white space, and A-Z to a-z, as tables over bytes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

LONG = 256  # bytes of a span from which on it is hashed by itself


SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")


def text_parts(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about `size` bytes that end between words; a longer word is not cut."""
    begin = 0
    while begin < len(text):
        end = begin + size
        if end < len(text):
            end = max(text.rfind(space, begin, end) for space in SPACES)
            if end <= begin:
                found = (text.find(space, begin + size) for space in SPACES)
                end = min((at for at in found if at >= 0), default=len(text))
        yield text[begin : end + 1]
        begin = end + 1


@dataclass
class Words:
    """Bytes of all texts, first and last (exclusive) byte of each word, and words per text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    count: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Place of each text's first word; one more at the end."""
        return np.concatenate([[0], np.cumsum(self.count)])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins; nulls are empty."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text; with `lower`, A-Z become a-z."""
    data, offsets = text_bytes(texts)
    if lower:
        data = LOWER[data]
    word = ~SPACE[data]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    opens[edge] = word[edge]
    closes[edge - 1] = word[edge - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    count = np.diff(np.searchsorted(start, offsets))
    return Words(data, start, end, count)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finaliser of a well known generator); a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes start..end of each span, equal for equal bytes wherever they stand.

    Eight bytes a round are taken in by a bijection that is not linear, so no pair of words
    collides by the form of its letters. Spans of up to 8 bytes of one length never do. What is held beside the
    data follows the number of spans, not their bytes.
    """
    size = end - start
    out = mix(size.astype(np.uint64))
    if len(data) < 8:
        data = np.concatenate([data, np.zeros(8, np.uint8)])
    data = np.ascontiguousarray(data)
    eights = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, strides=(1,))
    last = len(eights) - 1
    open_, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(open_):
        place, left = start[open_] + at, np.minimum(size[open_] - at, 8)
        # Near the end of the data the eight bytes begin earlier, and those before the place go.
        early = np.maximum(place - last, 0)
        lane = eights[place - early] >> (8 * early).astype(np.uint64)
        lane = lane & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - left)).astype(np.uint64))
        out[open_] = mix(out[open_] ^ lane)
        at += 8
        open_ = open_[size[open_] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].data)
    return out


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of the pair of two hashes; order matters."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + right + np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k neighbours, for each place that has as many after it, by doubling."""
    done, built = hashes, 1
    out, covered = None, 0
    while k:
        if k & 1:
            if out is None:
                out, covered = done, built
            else:
                n = len(done) - covered
                out = chain(out[: max(n, 0)], done[covered:])
                covered += built
        k >>= 1
        if k:
            done = chain(done[: max(len(done) - built, 0)], done[built:])
            built *= 2
    return out
