"""Words of whole texts as 64-bit hashes, vectorised over Arrow batches.

Texts are cut into words by a table of separator bytes after lower-casing A-Z.  A word's hash is a polynomial
over its bytes, taken from one running sum over the buffer, then mixed.  Buffers are processed in slices of
about a megabyte; a longer text is cut at separators, so memory follows the slice, not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of bytes that belong to words: all but those in the inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low:high + 1] = False
    return table


NON_SPACE = separators((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        row = np.full(size, base, dtype=np.uint64)
        row[:1] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


class Powers:
    """Powers for the slices of one batch, computed for the longest of them so far."""

    def __init__(self):
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size > len(self.up):
            self.up, self.down = _powers(size)
        return self.up, self.down


def spans_of_words(low: np.ndarray, bounds: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in a buffer of texts; ``bounds`` are the texts' offsets, at which words end."""
    n = len(low)
    word = in_word[low]
    begin, finish = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    finish[:-1] &= ~word[1:]
    firsts = bounds[:-1][bounds[:-1] < n]
    begin[firsts] = word[firsts]
    lasts = bounds[1:] - 1
    lasts = lasts[lasts >= 0]
    finish[lasts] = word[lasts]
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def hash_spans(low: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of the bytes of each span."""
    up, down = powers.of(len(low))
    sums = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[low] * up[:len(low)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def hash_words(buf: np.ndarray, bounds: np.ndarray, in_word: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Words per text, and the hashes of all words in order; ``bounds`` are the texts' offsets in ``buf``."""
    if len(buf) == 0:
        return np.zeros(len(bounds) - 1, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    low = LOWER[buf]
    start, end = spans_of_words(low, bounds, in_word)
    return np.diff(np.searchsorted(start, bounds)), hash_spans(low, start, end, powers)


def _long_text(buf: np.ndarray, in_word: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of one long text, cut behind separators."""
    parts, at = [], 0
    while at < len(buf):
        end = min(at + SLICE_BYTES, len(buf))
        while end < len(buf):       # go on to the next separator; a word may be longer than a slice
            rest = LOWER[buf[end - 1:end - 1 + SLICE_BYTES]]
            stops = np.flatnonzero(~in_word[rest])
            if stops.size:
                end += int(stops[0])
                break
            end = min(end + SLICE_BYTES, len(buf))
        piece = buf[at:end]
        parts.append(hash_words(piece, np.array([0, len(piece)]), in_word, powers)[1])
        at = end
    return np.concatenate(parts)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def text_slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about a slice together; a longer text stands alone."""
    at, last = 0, len(offsets) - 1
    while at < last:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, at + 1), last)
        yield at, end
        at = end


def word_slices(column: pa.Array, in_word: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text, words per text and word hashes of successive slices of whole texts."""
    data, offsets = text_buffer(column)
    powers = Powers()
    for a, b in text_slices(offsets):
        buf = data[offsets[a]:offsets[b]]
        if len(buf) > 2 * SLICE_BYTES and b == a + 1:
            hashes = _long_text(buf, in_word, powers)
            yield a, np.array([len(hashes)]), hashes
        else:
            counts, hashes = hash_words(buf, offsets[a:b + 1] - offsets[a], in_word, powers)
            yield a, counts, hashes


def runs_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words (``len - size + 1`` of them), texts not regarded."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    factor = 1
    for j in range(size):
        total += hashes[j:j + n] * np.uint64(factor)
        factor = factor * _BASE % (1 << 64)
    return mix(total + np.uint64(size))
