"""A compressed full-text index over sequences of word numbers: BWT in a wavelet matrix."""

from __future__ import annotations

import numpy as np


_BELOW = np.array([(1 << k) - 1 for k in range(64)], np.uint64)


def _number_type(largest: int) -> type:
    return np.int32 if largest < 1 << 30 else np.int64


class BitVector:
    """Packed bits with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)[:-1]]).astype(_number_type(len(bits)))
        self.zeros = len(bits) - int(self.before[-1]) - int(ones[-1])

    def rank(self, ends: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = ends >> 6
        ones = np.bitwise_count(self.words[at] & _BELOW[ends & 63])
        return self.before[at] + ones


class WaveletMatrix:
    """Counts of a symbol in any prefix of a sequence of numbers below `symbols`."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.number = _number_type(max(len(sequence), symbols))
        self.levels = []
        sequence = sequence.astype(self.number)
        for level in range(self.depth - 1, -1, -1):
            bits = sequence & (1 << level) != 0
            self.levels.append(BitVector(bits))
            sequence = np.concatenate([sequence[~bits], sequence[bits]])
        self.start = np.full(symbols, -1, self.number)  # where the last level has the symbol, all of them side by side
        fresh = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]])[: len(sequence)])
        self.start[sequence[fresh]] = fresh
        absent = np.flatnonzero(self.start < 0).astype(self.number)
        self.start[absent] = self._walk(absent, np.zeros(len(absent), self.number))

    def _walk(self, wanted: np.ndarray, ends: np.ndarray) -> np.ndarray:
        for k, level in enumerate(self.levels):
            ones = level.rank(ends)
            ends = np.where(wanted & (1 << (self.depth - 1 - k)) != 0, ones + level.zeros, ends - ones)
        return ends

    def rank(self, wanted: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each wanted symbol comes before its end."""
        wanted = wanted.astype(self.number, copy=False)
        return self._walk(wanted, ends.astype(self.number, copy=False)) - self.start[wanted]


def suffix_array(text: np.ndarray, context: int | None = None) -> np.ndarray:
    """Order of all suffixes by prefix doubling, or tripling where three ranks fit a key; zeros are separators that differ from one another.

    With `context`, at least the first `context` symbols are ordered and ties are left as they come: the intervals of
    patterns up to that length are the same, since a step in front only asks how many suffixes come before.
    """
    size = len(text)
    separators = text == 0
    rank = np.where(separators, np.cumsum(separators) - 1, text + int(separators.sum()))
    span = 1
    while True:
        ranks = int(rank.max()) + 2
        parts = 3 if ranks < 1 << 21 else 2
        keys = rank
        for k in range(1, parts):
            keys = keys * ranks
            keys[: max(size - k * span, 0)] += rank[k * span :] + 1
        order = np.argsort(keys)
        ordered = keys[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        span *= parts
        if fresh[-1] == size - 1 or (context is not None and span >= context):
            return order
        rank = np.empty(size, np.int64)
        rank[order] = fresh


class FMIndex:
    """Backward search over many sequences of positive numbers, which separators keep apart.

    `context` bounds the length of the patterns that will be asked for; None allows any length.
    """

    def __init__(self, sequences: list[np.ndarray], symbols: int, context: int | None = None):
        self._build(np.concatenate(sequences), np.array([len(s) for s in sequences], np.int64), symbols, context)

    @classmethod
    def joined(cls, numbers: np.ndarray, lengths: np.ndarray, symbols: int, context: int | None = None) -> FMIndex:
        """The index of sequences that lie one behind the other in `numbers`."""
        index = cls.__new__(cls)
        index._build(numbers, lengths, symbols, context)
        return index

    def _build(self, numbers: np.ndarray, lengths: np.ndarray, symbols: int, context: int | None) -> None:
        self.ends = np.cumsum(lengths + 1) - 1  # places of the separators
        self.lengths = lengths
        self.text = np.zeros(int(self.ends[-1]) + 1, np.int64)
        inside = np.ones(len(self.text), bool)
        inside[self.ends] = False
        self.text[inside] = numbers
        self.order = suffix_array(self.text, context)
        self.before = self.text[self.order - 1]  # the BWT
        self.wavelet = WaveletMatrix(self.before, symbols + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=symbols + 1))])

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front; an interval of one place needs no second count."""
        wide = np.flatnonzero(high - low > 1)
        counts = self.wavelet.rank(np.concatenate([symbols, symbols[wide]]), np.concatenate([low, high[wide]]))
        below = counts[: len(low)]
        up_to = below + ((high > low) & (self.before[np.minimum(low, len(self.before) - 1)] == symbols))
        up_to[wide] = counts[len(low) :]
        return self.first[symbols] + below, self.first[symbols] + up_to

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the suffix order, the interval of all suffixes that share its first `size` symbols."""
        padded = np.concatenate([self.text, np.zeros(size, np.int64)]).astype(self.wavelet.number)
        alike = np.arange(1, len(self.order))  # places that agree so far with the one before
        for k in range(size):
            symbol = padded[self.order[alike] + k]
            alike = alike[(symbol == padded[self.order[alike - 1] + k]) & (symbol != 0)]
        fresh = np.ones(len(self.order) + 1, bool)
        fresh[alike] = False
        edges = np.flatnonzero(fresh)
        sizes = np.diff(edges)
        return np.repeat(edges[:-1], sizes), np.repeat(edges[1:], sizes)

    def matching(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Interval of each window of the indexed sequences, by the place of its first symbol; -1 elsewhere.

        The sequences are streamed from right to left, side by side.  A match of full length gives up its
        last symbol, that is, goes to the interval of the shorter prefix, before it takes the next one in front.
        """
        found_low = np.full(len(self.text), -1, np.int64)
        found_high = np.full(len(self.text), -1, np.int64)
        shorter_low, shorter_high = self.runs(window - 1)
        by_length = np.argsort(-self.lengths, kind="stable")
        ends, lengths = self.ends[by_length], self.lengths[by_length]
        low = np.zeros(len(ends), np.int64)
        high = np.full(len(ends), len(self.text), np.int64)
        for taken in range(int(lengths[0]) if len(lengths) else 0):
            active = int(np.searchsorted(-lengths, -taken))  # sequences longer than what was taken
            low, high = low[:active], high[:active]
            if taken >= window:
                low, high = shorter_low[low], shorter_high[low]
            place = ends[:active] - 1 - taken
            low, high = self.step(self.text[place], low, high)
            if taken >= window - 1:
                found_low[place], found_high[place] = low, high
        return found_low, found_high
