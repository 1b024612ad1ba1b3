"""Words, spans and hashes of whole Arrow string columns, worked out on their UTF-8 bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that belong to words separated by ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Bytes of words made of digits, ASCII letters (lowered before) and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: As ALNUM without digits.
LETTER = ALNUM.copy()
LETTER[48:58] = False

_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _BASE, np.uint64))])
    return _POWERS


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about `limit` bytes; null is empty.

    A longer text is a run of its own, so memory follows the longest text, never the column.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    pa.default_memory_pool().release_unused()


class Words:
    """The words of a run of rows: `start`, `end` (byte places), `row`, `hash` (64 bits) and `first` (per row)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, prefix: int = 0):
        self.data = data = LOWER[data]
        rows, n = len(offsets) - 1, len(data)
        if not n:
            self.start = self.end = self.row = np.zeros(0, np.int64)
            self.hash = self.prefix_hash = np.zeros(0, np.uint64)
            self.first = np.zeros(rows + 1, np.int64)
            return
        mask = inside[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begin = mask.copy()
        begin[1:] &= ~mask[:-1] | edge[1:n]
        stop = mask.copy()
        stop[:-1] &= ~mask[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.row, np.arange(rows + 1))
        if not len(self.start):
            self.hash = self.prefix_hash = np.zeros(0, np.uint64)
            return
        place = np.arange(n, dtype=np.int32 if n < 2**31 else np.int64)
        latest = np.zeros(n, place.dtype)
        latest[self.start] = self.start
        within = place - np.maximum.accumulate(latest)
        value = _BYTE[data] * _powers(int((self.end - self.start).max()) + 1)[np.minimum(within, (self.end - self.start).max())]
        value[~mask] = 0
        self.hash = mix(np.add.reduceat(value, self.start))
        if prefix:
            value[within >= prefix] = 0
            self.prefix_hash = mix(np.add.reduceat(value, self.start), 1)


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the `width`-word shingles of each row; with fewer words, of all its words."""
    h, n = words.hash, len(words.hash)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled[: max(0, n - k)] += mix(h[k:], k + 2)
    rolled = mix(rolled)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            short = np.zeros(1, np.uint64)
            for k in range(b - a):
                short += mix(h[a + k : a + k + 1], k + 2)
            yield mix(short, int(b - a))
        else:
            yield np.zeros(0, np.uint64)


def word_hashes(texts: list[str], inside: np.ndarray) -> list[np.ndarray]:
    """The word hashes of a few strings."""
    out = []
    for _, _, data, offsets in chunks(pa.array(texts, pa.large_string())):
        w = Words(data, offsets, inside)
        out += [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    return out
