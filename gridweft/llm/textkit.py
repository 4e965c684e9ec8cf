"""Vectorised text kernels: bytes, words and rolling hashes of whole Arrow batches in numpy.

A batch is cut into chunks of whole texts of about ``CHUNK`` bytes, so that the 8-byte arrays
derived from each byte stay small whatever the batch holds; one text longer than that is a chunk
of its own. ``tidy`` gives freed memory back to the system, as workers live on after their task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
#: Batches that a task returns between two returns of freed memory.
TIDY_BATCHES = 16
U64 = np.uint64
#: Odd multiplier of the polynomial hashes (mod 2**64) and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Value of each byte in polynomial hashes; far from linear in the byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(BASE))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * column.offset) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give back what Arrow and the C library hold of freed memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Batches) -> Batches:
    """The same work on batches, with freed memory given back now and then and at the end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for k, out in enumerate(run(batches), start=1):
                yield out
                if k % TIDY_BATCHES == 0:
                    release()
        finally:
            release()

    return wrapped


def chunks(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of whole texts of about ``limit`` bytes."""
    limit = limit or CHUNK
    raw, offsets = text_bytes(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U64)


class Rolling:
    """Polynomial prefix hashes of a byte chunk: the hash of any slice in constant time."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.inverse = powers(BASE_INV, n + 1)
        self.prefix = np.zeros(n + 1, dtype=U64)
        np.cumsum(BYTE_VALUE[raw] * powers(BASE, n), dtype=U64, out=self.prefix[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(U64))

    def fixed(self, k: int) -> np.ndarray:
        """Hash of the k bytes from each position at which k bytes are left in the chunk."""
        m = len(self.prefix) - k
        if m <= 0:
            return np.zeros(0, dtype=U64)
        return mix((self.prefix[k:] - self.prefix[:m]) * self.inverse[:m] + U64(k))


def words(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text): maximal runs of bytes that are no separator."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[raw]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cut] |= inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of runs of the given lengths, one run after another."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))
