"""Words of whole texts and hashes of word sequences, as numpy arrays over an Arrow column.

A chunk of rows is one byte buffer with row offsets. Words are (start, end) byte spans; hashes
are polynomials over the bytes (words) or over the words (windows), so every rolling window of a
chunk costs two lookups in a running sum. Words and windows never cross rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
PART_BYTES = 1 << 18
_U = np.uint64


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """bool[256], true for bytes that separate words."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low:high + 1] = True
    return out


#: Separators of the two word rules of this package (the second one after lower-casing A-Z).
SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def _draw(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=_U)


def byte_codes(lower: bool) -> np.ndarray:
    """A random 64-bit code per byte; `lower` gives A-Z the codes of a-z."""
    codes = _draw(11, 256)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASES = {"byte": 0x9E3779B97F4A7C15, "one": 0xD1342543DE82EF95, "two": 0xAF251AF3B0F025B5}


_grown: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown as needed and kept once."""
    if base not in _grown or len(_grown[base][0]) < size:
        n = (size // 65_536 + 1) * 65_536
        up, down = np.full(n, _U(_BASES[base])), np.full(n, _U(pow(_BASES[base], -1, 2**64)))
        up[0] = down[0] = 1
        _grown[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _grown[base]


def _span_hash(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: str) -> np.ndarray:
    """Position-free polynomial hash of values[first:last], for many spans at once."""
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[:len(values)], out=total[1:])
    length = (last - first).astype(_U)
    return mix((total[last] - total[first]) * down[first] + length * _U(0x632BE59BD9B4E019))


class Chunk:
    """Words of some rows. `row_first[r]:row_first[r+1]` are the words of row r."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool):
        self.data, self.offsets, self.lower = data, offsets, lower
        inside = ~separators[data]
        prev = np.zeros(len(data) + 1, bool)
        prev[1:] = inside
        cuts = offsets[:-1]
        start = inside.copy()
        start &= ~prev[:-1]
        cuts = cuts[cuts < len(data)]
        start[cuts] = inside[cuts]
        nxt = np.zeros(len(data) + 1, bool)
        nxt[:-1] = inside
        end = inside & ~nxt[1:]
        cuts = offsets[1:] - 1
        cuts = cuts[cuts >= 0]
        end[cuts] = inside[cuts]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.row_first = np.searchsorted(self.start, offsets)
        self.n_rows = len(offsets) - 1
        self.n_words = np.diff(self.row_first)

    def word_hashes(self) -> np.ndarray:
        """Hash of each word; bytes are taken in parts, so temporary arrays stay small."""
        codes, out, low = byte_codes(self.lower), np.empty(len(self.start), _U), 0
        while low < len(self.start):
            first = self.start[low]
            high = int(np.searchsorted(self.start, first + PART_BYTES))
            last = self.end[high - 1]
            out[low:high] = _span_hash(codes[self.data[first:last]], self.start[low:high] - first,
                                       self.end[low:high] - first, "byte")
            low = high
        return out

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), self.n_words)

    def window_starts(self, size: int) -> np.ndarray:
        """Word positions at which a window of `size` words of one row starts."""
        left = np.repeat(self.row_first[1:], self.n_words) - np.arange(len(self.start))
        return np.flatnonzero(left >= size)


def window_hashes(words: np.ndarray, starts: np.ndarray, size, base: str = "one") -> np.ndarray:
    """Hash of `size` words (a number or one per start) from each start."""
    if not len(starts):
        return np.zeros(0, _U)
    return _span_hash(words, starts, starts + size, base)


def release() -> None:
    """Hand freed memory back to the system: workers live on after a task, beside others."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def cuts(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def chunks(column: pa.Array, separators: np.ndarray, lower: bool,
           limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Chunk]]:
    """(first row, end row, Chunk) over a string column."""
    data, offsets = utf8_buffer(column)
    for low, high in cuts(offsets, limit):
        yield low, high, Chunk(
            data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], separators, lower)
