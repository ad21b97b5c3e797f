"""A two-level n-gram trie in Elias-Fano levels: contexts, their words, quantised probabilities."""

from __future__ import annotations

import mmap

import numpy as np

STEPS = 2000  # quantisation steps of a decimal logarithm


def mapped(array: np.ndarray) -> np.ndarray:
    """The array in an anonymous memory map of its own, read-only."""
    if not array.nbytes:
        return array
    area = mmap.mmap(-1, array.nbytes)
    area.write(array.tobytes())
    out = np.frombuffer(area, array.dtype)
    out.flags.writeable = False
    return out


def quantised(logs: np.ndarray) -> np.ndarray:
    """Decimal logarithms of probabilities in 16 bits, rounded down so that sums stay at most one."""
    return np.minimum(np.ceil(-np.asarray(logs) * STEPS - 1e-9), 65535).astype(np.uint16)


def _selection_table() -> np.ndarray:
    """Place of the r-th one in each byte."""
    table = np.zeros((256, 8), np.uint8)
    for byte in range(256):
        ones = [b for b in range(8) if byte >> b & 1]
        table[byte, : len(ones)] = ones
    return table


_SELECT = _selection_table()


class EliasFano:
    """A non-decreasing sequence of unsigned numbers: low bits packed, high bits in unary."""

    def __init__(self, values: np.ndarray, universe: int):
        values = values.astype(np.uint64)
        self.size = len(values)
        self.width = max(0, int(universe // max(self.size, 1)).bit_length() - 1)
        width = np.uint64(self.width)
        high = (values >> width).astype(np.int64)
        bits = np.zeros(self.size + (int(universe) >> self.width) + 2, np.uint8)
        bits[high + np.arange(self.size)] = 1
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(packed) // 8 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = mapped(words)
        ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        self.ones_before = mapped(np.concatenate([[0], ones[:-1]]))
        self.zeros_before = mapped(64 * np.arange(len(words)) - self.ones_before)
        self.low = mapped(self._packed(values & ((np.uint64(1) << width) - np.uint64(1))))

    def _packed(self, low: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size * self.width // 64 + 2, np.uint64)
        at = np.arange(self.size, dtype=np.int64) * self.width
        shift = (at & 63).astype(np.uint64)
        np.bitwise_or.at(out, at >> 6, low << shift)
        over = (at & 63) + self.width > 64
        np.bitwise_or.at(out, (at[over] >> 6) + 1, low[over] >> (np.uint64(64) - shift[over]))
        return out

    def _low(self, index: np.ndarray) -> np.ndarray:
        at = index * self.width
        shift = (at & 63).astype(np.uint64)
        word = self.low[at >> 6] >> shift
        over = (at & 63) + self.width > 64
        word[over] |= self.low[(at[over] >> 6) + 1] << (np.uint64(64) - shift[over])
        return word & ((np.uint64(1) << np.uint64(self.width)) - np.uint64(1))

    def _select(self, before: np.ndarray, words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the rank-th set bit of `words`, given the set bits before each word."""
        block = np.searchsorted(before, rank, "right") - 1
        octets = np.ascontiguousarray(words[block]).view(np.uint8).reshape(-1, 8)
        counts = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.int64)
        left = rank - before[block]
        byte = (counts <= left[:, None]).sum(1)
        rows = np.arange(len(rank))
        left = left - np.where(byte > 0, counts[rows, byte - 1], 0)
        return block * 64 + byte * 8 + _SELECT[octets[rows, byte], left]

    def get(self, index: np.ndarray) -> np.ndarray:
        """Values at the indices."""
        place = self._select(self.ones_before, self.words, index)
        return ((place - index).astype(np.uint64) << np.uint64(self.width)) | self._low(index)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many values have smaller high bits."""
        out = np.zeros(len(high), np.int64)
        some = high > 0
        zero = high[some] - 1
        out[some] = self._select(self.zeros_before, ~self.words, zero) - zero
        return out

    def successor(self, wanted: np.ndarray) -> np.ndarray:
        """Index of the first value that is not smaller, by search among those with the same high bits."""
        wanted = wanted.astype(np.uint64)
        high = (wanted >> np.uint64(self.width)).astype(np.int64)
        target = wanted & ((np.uint64(1) << np.uint64(self.width)) - np.uint64(1))
        low, end = self._before(high), self._before(high + 1)
        while True:
            open_ = np.flatnonzero(low < end)
            if not len(open_):
                return low
            middle = (low[open_] + end[open_]) // 2
            smaller = self._low(middle) < target[open_]
            low[open_[smaller]] = middle[smaller] + 1
            end[open_[~smaller]] = middle[~smaller]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted value, -1 where it is not there."""
        if not self.size or not len(wanted):
            return np.full(len(wanted), -1, np.int64)
        at = self.successor(wanted)
        inside = at < self.size
        out = np.full(len(wanted), -1, np.int64)
        there = at[inside]
        same = self.get(there) == wanted[inside].astype(np.uint64)
        out[np.flatnonzero(inside)[same]] = there[same]
        return out


class BigramTrie:
    """Contexts, the words seen after each, and their quantised smoothed probabilities.

    Interpolated absolute discounting: P(w | v) = max(c(vw) - D, 0) / c(v) + D T(v) / c(v) P(w) with
    T(v) words seen after v.  Level one holds the contexts' codes, monotone pointers to their words and
    the weights D T / c; level two holds the words of all contexts as one monotone sequence
    (context number times vocabulary, plus the word's number) and the probabilities.
    """

    def __init__(self, contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, lower: np.ndarray, discount: float, totals: dict[int, tuple[int, int, float]]):
        """Sorted distinct pairs with counts; `lower` is P(w) of each pair, `totals` overrides (c, T, D) of a context, also of one without pairs here."""
        codes = np.union1d(contexts, np.array(list(totals), np.uint64))
        first, number = np.searchsorted(contexts, codes), np.searchsorted(codes, contexts)
        kinds = np.bincount(number, minlength=len(codes))
        total = np.bincount(number, weights=counts, minlength=len(codes)).astype(np.int64)
        seen, discounts = kinds.copy(), np.full(len(codes), discount)
        for code, (c, t, d) in totals.items():
            at = int(np.searchsorted(codes, np.uint64(code)))
            if at < len(codes) and codes[at] == np.uint64(code):
                total[at], seen[at], discounts[at] = c, t, d
        vocabulary, word = np.unique(words, return_inverse=True)
        weight = discounts * seen / np.maximum(total, 1)
        probability = np.maximum(counts - discounts[number], 0) / total[number] + weight[number] * lower
        self.contexts = EliasFano(codes, 1 << 64)
        self.pointers = EliasFano(np.concatenate([first, [len(counts)]]), len(counts) + 1)
        self.vocabulary = EliasFano(vocabulary, 1 << 64)
        self.span = max(len(vocabulary), 1)
        order = np.lexsort((word, number))
        self.words = EliasFano(number[order] * self.span + word[order], len(codes) * self.span + 1)
        self.weights = mapped(quantised(np.log10(np.minimum(weight, 1))))
        self.probabilities = mapped(quantised(np.log10(probability[order])))

    def logs(self, contexts: np.ndarray, context: np.ndarray, words: np.ndarray, word: np.ndarray, lower_logs: np.ndarray) -> np.ndarray:
        """log10 P(w | v) of pairs (contexts[context], words[word]): stored, or weight and lower order, or the lower order alone."""
        out = lower_logs.astype(np.float64).copy()
        number, name = self.contexts.find(contexts)[context], self.vocabulary.find(words)[word]
        known = np.flatnonzero(number >= 0)
        out[known] -= self.weights[number[known]] / STEPS
        both = np.flatnonzero((number >= 0) & (name >= 0))
        wanted = number[both] * self.span + name[both]
        at = self.words.successor(wanted)
        ends = self.pointers.get(np.arange(1, len(self.weights) + 1)).astype(np.int64)
        near = np.flatnonzero(at < ends[number[both]])  # the successor may belong to the next context
        hit = near[self.words.get(at[near]).astype(np.int64) == wanted[near]]
        out[both[hit]] = -(self.probabilities[at[hit]] / STEPS)
        return out
