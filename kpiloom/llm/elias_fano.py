"""Monotone sequences in Elias-Fano form, searched for many values side by side.

A value's low bits are packed one after another; its high bits are a one in a bit field, at
high + rank. The arrays lie in one file that is mapped, not read.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

# Place of the one number r (from 0) in a byte, at 8 * byte + r.
IN_BYTE = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _ones = [k for k in range(8) if _byte >> k & 1]
    IN_BYTE[_byte, : len(_ones)] = _ones
IN_BYTE = IN_BYTE.reshape(-1)

RUN = 1 << 15  # values looked for at a time, so that what is held for them stays in the cache


def _before(field: np.ndarray, ones: bool) -> np.ndarray:
    """Ones (or zeros) before each byte, and in all."""
    count = np.concatenate([[0], np.cumsum(np.bitwise_count(field), dtype=np.int64)])
    return count if ones else np.arange(len(field) + 1) * 8 - count


def _select(field: np.ndarray, before: np.ndarray, rank: np.ndarray, ones: bool) -> np.ndarray:
    """Place of the one (or zero) number `rank`, from 0."""
    at = np.searchsorted(before, rank, side="right") - 1
    byte = field[at] if ones else ~field[at]
    return at * 8 + IN_BYTE[byte * np.int64(8) + (rank - before[at])]


class EliasFano:
    """values: sorted uint64 below `universe`; equal values are allowed."""

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.size = n
        self.low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64) if self.low_bits < 64 else np.zeros(n, np.int64)
        top = int((universe - 1) >> self.low_bits) if universe else 0
        field = np.zeros(((n + top + 2) // 64 + 1) * 64, bool)
        field[high + np.arange(n)] = True
        self.field = np.packbits(field, bitorder="little")
        self.low = self._packed(values)
        self.ones, self.zeros = _before(self.field, True), _before(self.field, False)

    def _packed(self, values: np.ndarray) -> np.ndarray:
        b = self.low_bits
        out = np.zeros(len(values) * b // 64 + 2, np.uint64)
        if b:
            low = values & np.uint64((1 << b) - 1)
            at = np.arange(len(values), dtype=np.int64) * b
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            # Values come in order, so those of one word stand together and are joined by a scan.
            np.bitwise_or.at(out, word, low << shift)
            over = shift.astype(np.int64) + b > 64
            np.bitwise_or.at(out, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        return out

    def _lows(self, at: np.ndarray) -> np.ndarray:
        b = self.low_bits
        if not b:
            return np.zeros(len(at), np.uint64)
        bit = at * b
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        value = self.low[word] >> shift
        rest = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (value | rest) & np.uint64((1 << b) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        if len(at) > RUN:
            return np.concatenate([self.get(at[i : i + RUN]) for i in range(0, len(at), RUN)])
        high = _select(self.field, self.ones, at, True) - at
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(at)

    def successor(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Place of the first element that is not below each value, between first and last.

        The high bits give the run of elements to look at, by two selections of zeros; the low bits
        are searched inside that run by halving.
        """
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        begin = np.where(high > 0, _select(self.field, self.zeros, np.maximum(high - 1, 0), False) + 1 - high, 0)
        end = _select(self.field, self.zeros, high, False) - high
        if first is not None:
            begin, end = np.clip(begin, first, last), np.clip(end, first, last)
        wanted = values & np.uint64((1 << self.low_bits) - 1)
        live = np.flatnonzero(begin < end)
        while len(live):
            middle = (begin[live] + end[live]) // 2
            below = self._lows(middle) < wanted[live]
            begin[live] = np.where(below, middle + 1, begin[live])
            end[live] = np.where(below, end[live], middle)
            live = live[begin[live] < end[live]]
        return begin

    def find(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, -1 if it is not there."""
        if not self.size:
            return np.full(len(values), -1, np.int64)
        if len(values) > RUN:
            runs = [slice(i, i + RUN) for i in range(0, len(values), RUN)]
            return np.concatenate([self.find(values[r], *(x if x is None else x[r] for x in (first, last))) for r in runs])
        at = self.successor(values, first, last)
        end = self.size if last is None else last
        there = at < end
        there[there] = self.get(at[there]) == values[there]
        return np.where(there, at, -1)


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays as views of one mapped file without a name, which goes with the last view."""
    with tempfile.TemporaryFile() as file:
        places = []
        for a in arrays:
            places.append(file.tell())
            file.write(a.tobytes())
            file.write(b"\0" * (-file.tell() % 8))
        file.write(b"\0" * 8)
        file.flush()
        whole = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    return [np.frombuffer(whole, a.dtype, len(a), at) for a, at in zip(arrays, places, strict=True)]
