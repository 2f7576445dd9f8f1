"""A compressed full-text index over numbers: wavelet matrix, rank directories, backward search.

All searches run many patterns side by side, as numpy arrays with one place for each pattern.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of any symbol in a sequence, in about 1.5 bits for each bit of a symbol."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.size = len(values)
        self.depth = max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (values >> level) & 1 == 1
            padded = np.zeros((self.size // 64 + 1) * 64, bool)
            padded[: self.size] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.uint32))
            self.zeros.append(self.size - int(bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where `at` goes if each level sorts by the symbol's bit; differences are counts of the symbol."""
        at = at.astype(np.int64)
        for k in range(self.depth):
            word, inside = at >> 6, (at & 63).astype(np.uint64)
            below = self.words[k][word] & ((np.uint64(1) << inside) - np.uint64(1))
            ones = self.counts[k][word].astype(np.int64) + np.bitwise_count(below)
            bit = (symbol >> (self.depth - 1 - k)) & 1
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    steps = np.concatenate([[0], np.cumsum(keys[order][1:] != keys[order][:-1])])
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = steps
    return order, ranks


def _shifted(ranks: np.ndarray, by: int) -> np.ndarray:
    """ranks + 1 of the place `by` further on; 0 beyond the end."""
    out = np.zeros(len(ranks), np.int64)
    if by < len(ranks):
        out[:-by or None] = ranks[by:] + 1
    return out


class FMIndex:
    """Index over passages of symbols 1..n, each passage followed by a 0.

    Suffixes are sorted by their first 64 symbols or more, which is all that patterns of up to
    `length` < 64 symbols need: their suffixes stand together, and counting symbols before an
    interval gives the interval of the pattern that is longer by one on the left.
    """

    def __init__(self, text: np.ndarray, symbols: int, length: int):
        if not 2 <= length < 64:
            raise ValueError("patterns of 2 to 63 symbols")
        self.length = length
        kept = {}
        order, ranks = _ranks(text)
        kept[1] = ranks
        depth = 1
        while depth < 64:
            order, ranks = _ranks(ranks * (len(text) + 1) + _shifted(ranks, depth))
            depth *= 2
            kept[depth] = ranks
        self.order = order
        # Neighbours in the order that share length - 1 symbols: compared by powers of two.
        same = np.ones(len(text), bool)
        same[0] = False
        place, rest = 0, length - 1
        for part in (32, 16, 8, 4, 2, 1):
            if rest & part:
                at = _shifted(kept[part], place) if place else kept[part] + 1
                same[1:] &= at[order[1:]] == at[order[:-1]]
                place += part
        opens = np.flatnonzero(~same)
        run = np.cumsum(~same) - 1
        self.run_begin = opens[run]
        self.run_end = np.append(opens[1:], len(text))[run]
        before = text[order - 1]  # the last symbol, a 0, stands before the first
        self.before = WaveletMatrix(before, symbols)
        total = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        every = np.arange(symbols)
        self.base = total[:-1] - self.before.follow(every, np.zeros(symbols, np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol on the left."""
        both = self.before.follow(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.base[symbol]
        return base + both[: len(symbol)], base + both[len(symbol) :]

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first length - 1 symbols of patterns found at `low`."""
        return self.run_begin[low], self.run_end[low]

    def windows(self, passages: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of all windows of `length` symbols of passages that are in the index.

        passages: (passage, symbol), aligned at the right end; sizes: symbols of each. Each passage is
        streamed from its right end; the match is kept at length - 1 symbols, so that its
        statistics reach the threshold exactly where a window is found. Returns (passage, window) arrays,
        the last window first; an interval is empty where a passage is too short.
        """
        n, width = passages.shape
        order = np.argsort(-sizes, kind="stable")
        passages, sizes = passages[order], sizes[order]
        steps = max(0, width - self.length + 1)
        found = np.zeros((2, n, steps), np.int64)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.order), np.int64)
        for t in range(width):
            live = int(np.searchsorted(-sizes, -t, side="left"))  # passages with more than t symbols
            if not live:
                break
            low, high = self.extend(passages[:live, width - 1 - t], low[:live], high[:live])
            if (low >= high).any():
                raise ValueError("a streamed passage is not in the index")
            if t >= self.length - 1:
                found[0, :live, t - self.length + 1] = low
                found[1, :live, t - self.length + 1] = high
                low, high = self.shorten(low)
        back = np.empty_like(found)
        back[:, order] = found
        return back[0], back[1]


def least_in(intervals: tuple[np.ndarray, np.ndarray], values: np.ndarray, empty: int) -> np.ndarray:
    """The least of `values` in each interval; intervals are equal or apart."""
    low, high = intervals
    filled = high > low
    begin, at = np.unique(low[filled], return_index=True)
    end = high[filled][at]
    out = np.full(low.shape, empty, values.dtype)
    if len(begin):
        edges = np.stack([begin, end], axis=1).ravel()
        least = np.minimum.reduceat(np.append(values, empty), edges)[::2]
        out[filled] = least[np.searchsorted(begin, low[filled])]
    return out
