"""Words by their places in one byte string, so that numpy works on all of them at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

CHUNK = 1 << 18  # bytes of text worked on at a time, so that arrays stay in the cache
LONG = 64  # bytes; longer words are taken one by one
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def by_size(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, CHUNK bytes at a time; a longer text comes alone."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        if held and size + len(text) > CHUNK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte behind it; words are those of bytes.split()."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    np.logical_and(raw != 32, raw - np.uint8(9) > 4, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2].copy(), edges[1::2].copy()


def _eights(text: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray]]:
    """Bytes 0 to 7, 8 to 15 and so on of the words up to LONG that have them: which words, and the bytes, zero behind their end."""
    padded = np.frombuffer(text + b"\0" * (16 - len(text) % 8), "<u8")
    lengths = ends - starts
    lengths[lengths > LONG] = 0
    which: np.ndarray | slice = slice(None)
    for done in range(0, LONG, 8):
        if done:
            which = np.flatnonzero(lengths > done)
            if not len(which):
                return
        at = starts[which] + done
        shift = ((at & 7) << 3).view(np.uint64)
        at >>= 3
        bits = padded[at]
        bits >>= shift
        at += 1
        behind = padded[at]
        behind <<= np.uint64(1)
        behind <<= np.uint64(63) - shift
        bits |= behind
        bits &= _MASKS[np.minimum(lengths[which] - done, 8)]
        yield which, bits


def place_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at these places, from their bytes alone."""
    hashes = (ends - starts).astype(np.uint64)
    hashes *= np.uint64(0x9E3779B97F4A7C15)
    for which, bits in _eights(text, starts, ends):
        bits ^= hashes[which]
        bits *= np.uint64(0xBF58476D1CE4E5B9)
        bits ^= bits >> np.uint64(32)
        hashes[which] = bits
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        hashes[k] = xxhash.xxh64_intdigest(text[starts[k] : ends[k]])
    return hashes


def same_words(text: bytes, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each word has the same bytes as the word with the number in `other`."""
    if not np.array_equal(ends - starts, (ends - starts)[other]):
        return False
    for which, bits in _eights(text, starts, ends):
        every = np.zeros(len(starts), np.uint64)
        every[which] = bits
        if not np.array_equal(bits, every[other[which]]):
            return False
    long = np.flatnonzero(ends - starts > LONG).tolist()
    return all(text[starts[k] : ends[k]] == text[starts[j] : ends[j]] for k, j in zip(long, other[long].tolist()))


def numbered(text: bytes) -> tuple[np.ndarray, int]:
    """The words of the text as numbers from 1, equal for equal words only, and how many numbers there are."""
    starts, ends = word_places(text)
    hashes = place_hashes(text, starts, ends)
    order = np.argsort(hashes)
    ordered = hashes[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(order)]
    numbers = np.empty(len(order), np.int64)
    numbers[order] = np.cumsum(fresh)
    first = order[fresh]
    if same_words(text, starts, ends, first[numbers - 1]):
        return numbers, len(first)
    known: dict[bytes, int] = {}  # two words have one hash
    return np.array([known.setdefault(w, len(known) + 1) for w in text.split()], np.int64), len(known)
