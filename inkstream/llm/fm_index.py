"""A compressed FM-index over sequences of numbers: the Burrows-Wheeler transform in a wavelet matrix of packed bits, about
one and a half bits for each bit of a symbol, and the document of each suffix in as few bytes as name one. Neither the text
nor the suffix array is kept."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """The ones before each position."""
        word = at >> 6
        rest = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(rest)


class WaveletMatrix:
    """rank of a symbol before a position, in one step for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.bits.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix up to `at` ends among equal symbols of the last level; differences of places are ranks."""
        for level, bits, zeros in zip(range(self.levels - 1, -1, -1), self.bits, self.zeros):
            ones = bits.ones(at)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of suffixes in order, by prefix doubling. Symbol 0 ends a sequence: each 0 is less than what follows it in
    the text, so no comparison runs past one, and the work is n log(longest sequence) sorts."""
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols + ends.sum())
    span = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - span] = rank[span:] + 1
        key = rank * np.int64(n + int(rank.max()) + 2) + np.where(_crosses(ends, span), 0, ahead)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        span *= 2


def _crosses(ends: np.ndarray, span: int) -> np.ndarray:
    """Whether an end stands within the first `span` symbols from each position."""
    before = np.concatenate([[0], np.cumsum(ends)])
    last = np.minimum(np.arange(len(ends)) + span, len(ends))
    return before[last] > before[:-1]


class FmIndex:
    """symbols: sequences of numbers from 1 to size - 1, each followed by 0. documents: whose each symbol is, from 0."""

    def __init__(self, symbols: np.ndarray, size: int, documents: np.ndarray):
        order = suffix_order(symbols)
        self.documents = documents[order].astype(np.min_scalar_type(int(documents.max())))
        self.tree = WaveletMatrix(symbols[order - 1], size)
        count = np.bincount(symbols, minlength=size)
        every = np.arange(size)
        self.first = np.concatenate([[0], np.cumsum(count)[:-1]]) - self.tree.place(every, np.zeros(size, np.int64))
        self.n = len(symbols)

    def statistics(self, symbols: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a streamed text at each of `ends`, by backward search: (length, low, high), where length is
        that of the longest match (up to `most`) that ends there and stands in the index more than once, and [low, high) its
        interval among the ordered suffixes. A match never runs over a 0."""
        length, low, high = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        going = np.arange(len(ends))
        for step in range(1, most + 1):
            at = ends[going] - step
            symbol = np.where(at >= 0, symbols[at], 0)
            a, z = (self.first[symbol] + self.tree.place(symbol, x[going]) for x in (low, high))
            more = (z - a > 1) & (symbol > 0)
            going = going[more]
            low[going], high[going], length[going] = a[more], z[more], step
            if not len(going):
                break
        return length, low, high

    def least_documents(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least document of each interval; intervals are equal or disjoint."""
        lows, which = np.unique(low, return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[which] = high
        padded = np.append(self.documents, self.documents.dtype.type(np.iinfo(self.documents.dtype).max))
        return np.minimum.reduceat(padded, np.stack([lows, highs], 1).ravel())[::2][which] if len(lows) else lows
