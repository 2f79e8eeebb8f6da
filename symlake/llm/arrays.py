"""Whole Arrow columns as numpy arrays: byte views, word boundaries and rolling hashes.

Everything here works on one slice of a batch at a time, so memory follows the slice (``SLICE_BYTES`` or one long
text), not the batch or the partition.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
#: Texts longer than this are hashed in pieces cut between words.
PIECE_BYTES = 4 << 20

U = np.uint64
MASK = (1 << 64) - 1
SPACES = bytes([9, 10, 11, 12, 13, 32])


def class_table(word_bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(word_bytes)] = True
    return table


#: Words of everything but ASCII white space.
NON_SPACE = class_table([b for b in range(256) if b not in SPACES])
#: Words of ASCII digits, letters and everything outside ASCII.
ALNUM = class_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else None
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif kind is not None:
        column = column.cast(kind)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each row the number of words before it."""
    inside = table[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < n]
    start[heads] = inside[heads]
    tails = heads[heads > 0] - 1
    end[tails] = inside[tails]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Roller:
    """Hashes of many slices of one sequence from one running sum: ``sum v[i] * b**i`` over the slice, shifted back to
    position 0 and mixed. Arithmetic is modulo 2**64, where every odd ``b`` has an inverse."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62, 1 << 63)) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.bytes = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << int(n - 1).bit_length()
            step = np.full(n, self.base, dtype=np.uint64)
            step[0] = 1
            back = np.full(n, self.inverse, dtype=np.uint64)
            back[0] = 1
            self.up, self.down = np.cumprod(step, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values)
        self._powers(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:n], dtype=np.uint64, out=total[1:])
        return mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, values: np.ndarray, n: int) -> np.ndarray:
        """Hash of every run of ``n`` values."""
        count = len(values) - n + 1
        if count <= 0:
            return np.zeros(0, dtype=np.uint64)
        at = np.arange(count)
        return self.spans(values, at, at + n)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of every word; long input goes in pieces cut between words, so tables stay small."""
        out = np.empty(len(starts), dtype=np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE_BYTES, side="right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            out[i:j] = self.spans(self.bytes[data[lo:hi]], starts[i:j] - lo, ends[i:j] - lo)
            i = j
        return out


def release() -> None:
    """Hand unused memory back to the system: Arrow's and, where the C library can, that of Python and numpy."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over record batches that hands its memory back at its end: a worker may wait for its next task for long."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return task


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``limit`` bytes of text, so that what is worked on follows the part."""
    for i, j in slices(utf8(batch[column])[1], limit):
        yield batch.slice(i, j - i)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
