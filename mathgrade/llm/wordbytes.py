"""Word boundaries and word hashes of whole text batches, in numpy.

Inside a Spark task a batch of texts arrives as one Arrow UTF-8 buffer. All
helpers work on such a buffer at once: words are the maximal runs of bytes
other than space and 0x09-0x0D (the separators are ASCII, so byte runs and
character runs agree), and a word's 64-bit hash is a difference of prefix sums
``sum table[byte] * BASE**position`` multiplied back to position 0, which is
exact in arithmetic modulo 2**64 because ``BASE`` is odd.

Batches are cut into pieces of at most ``PIECE_BYTES`` (a longer text makes a
piece of its own), which bounds a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(20240229))
BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (shift-xor-multiply rounds)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


_POWERS = {"n": 0, "up": None, "down": None}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, grown on demand and kept per process."""
    if _POWERS["n"] < n:
        size = max(n, 1 << 16)
        for key, base in (("up", BASE), ("down", BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into row ranges of at most ``limit`` bytes.

    Yields (first row, last row + 1, bytes, offsets); ``offsets`` has one entry
    more than rows and starts at 0. A null counts as an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    _, off_buf, data_buf = column.buffers()
    off = np.frombuffer(off_buf, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words, and ``first``: the
    index of each text's first word, with the word count as last entry."""
    n = len(data)
    inside = ~SEPARATOR[data]
    begin = inside.copy()
    if n:
        begin[1:] &= ~inside[:-1]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begin[cut] = inside[cut]
    starts = np.flatnonzero(begin)
    stop = inside.copy()
    if n:
        stop[:-1] &= ~(inside[1:] & ~begin[1:])
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span. Spans are in order and don't overlap; they are done in blocks of at most
    ``PIECE_BYTES`` (a longer span alone), so a very long text needs no more memory than a short one."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE_BYTES, "right")))
        first = starts[a]
        block = data[first:ends[b - 1]]
        up, down = _powers(len(block) + 1)
        sums = np.empty(len(block) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(BYTE_TABLE[block] * up[:len(block)], out=sums[1:])
        s, e = starts[a:b] - first, ends[a:b] - first
        out[a:b] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


_WINDOW = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n] * _WINDOW[0]
    for k in range(1, width):
        h += words[k:k + n] * _WINDOW[k]
    return mix64(h + np.uint64(width))


def string_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every string of ``k`` consecutive values (unsigned, 64 bits)."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * down[:n - k + 1])


def sliding(values: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every window of ``w`` values, by windows that double in size."""
    n, size = max(0, len(values) - w + 1), 1
    while size * 2 <= w:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[:n], values[w - size:w - size + n])
