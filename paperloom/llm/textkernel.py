"""Columnar text kernels: word, line and shingle work on whole Arrow buffers.

A chunk is a run of documents whose UTF-8 bytes lie next to each other.  All
kernels read those bytes once with numpy, so no per-word Python object exists.
Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 continuation bytes
are never in that set, so byte runs and character runs are the same words.

Hashes are 64-bit: a random value per byte times powers of an odd base, summed,
divided by the power at the start, and finalised together with the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240611))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Also breaks words at ASCII punctuation.
PUNCTUATION = _SPACE.copy()
PUNCTUATION[:128] = [not chr(i).isalnum() for i in range(128)]
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


class _Powers:
    """Powers of the base and of its inverse, extended as longer chunks come."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), CHUNK_BYTES // 4)
            cls.up = np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]).cumprod(dtype=np.uint64)
            cls.down = np.concatenate([[np.uint64(1)], np.full(size - 1, _INV)]).cumprod(dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as the empty text."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    dtype = np.int64 if wide else np.int32
    if off is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, dtype)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer document is a range alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(n, max(row + 1, stop))
        yield row, stop
        row = stop


class Chunk:
    """Words of a few documents, with lazily computed hashes and lines."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = _SPACE):
        self.data, self.offsets, self.lower = data, offsets, lower
        self.n = len(offsets) - 1
        word = np.empty(len(data) + 1, bool)
        np.logical_not(breaks[data], out=word[:-1])
        word[-1] = False
        first = word[:-1].copy()
        first[1:] &= ~word[:-2]
        edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        first[edges] = word[:-1][edges]
        last = word[:-1] & ~word[1:]
        last[edges - 1] = word[:-1][edges - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        # word index range of each document
        self.word_at = np.searchsorted(self.start, offsets)
        self.n_words = np.diff(self.word_at)
        self.word_doc = np.repeat(np.arange(self.n), self.n_words)
        self.is_word = word[:-1]
        self._prefix = self._hash = None

    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            up, _ = _Powers.upto(len(self.data) + 1)
            table = _LOWER_BYTE if self.lower else _BYTE
            self._prefix = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(table[self.data] * up[:-1], out=self._prefix[1:])
        return self._prefix

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range, equal for equal bytes."""
        p = self.prefix()
        _, down = _Powers.upto(len(self.data) + 1)
        return mix((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64))

    def word_hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.hash_spans(self.start, self.end)
        return self._hash

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows inside documents, and their documents.

        The window at word ``i`` is ``(i, ..., i + k - 1)``; windows come in
        order of ``i``.
        """
        h = self.word_hash()
        n = max(0, len(h) - k + 1)
        doc = self.word_doc[:n]
        inside = doc == self.word_doc[k - 1 : k - 1 + n]
        out = np.full(n, np.uint64(k))
        for j in range(k):
            out = mix(out * np.uint64(0x100000001B3) + h[j : j + n])
        return np.flatnonzero(inside), out[inside]

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each document."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each \\n-split line with a word in it."""
        cut = np.flatnonzero(self.data == 10)
        start = np.concatenate([self.offsets[:-1], cut + 1])
        end = np.concatenate([cut, self.offsets[1:]])
        start.sort()
        end.sort()
        doc = np.searchsorted(self.offsets, start, "right") - 1
        # a line after a final \n starts at the document's end: it is empty
        full = np.searchsorted(self.start, end) > np.searchsorted(self.start, start)
        return start[full], end[full], doc[full]


def chunks(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES, breaks: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Chunk]]:
    """(first row, last row + 1, chunk) over one Arrow string column."""
    data, offsets = buffers(column)
    for a, b in spans(offsets, limit):
        yield a, b, Chunk(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower, breaks)


def shingle_sets(chunk: Chunk, k: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct k-word shingle hashes.

    Fewer than k words make one shingle of the whole sequence; no word, none.
    """
    at, grams = chunk.grams(k)
    bounds = np.searchsorted(at, chunk.word_at)
    h = chunk.word_hash()
    for d in range(chunk.n):
        n = int(chunk.n_words[d])
        if n >= k:
            yield np.unique(grams[bounds[d] : bounds[d + 1]])
        elif n:
            out = np.uint64(1 << 32)
            one = h[chunk.word_at[d] : chunk.word_at[d + 1]]
            acc = np.full(1, out + np.uint64(n))
            for x in one:
                acc = mix(acc * np.uint64(0x100000001B3) + x)
            yield acc
        else:
            yield np.zeros(0, np.uint64)
