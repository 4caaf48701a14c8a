"""Words and word n-grams of Arrow string columns, as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text, as bytes. Nulls hold no words.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import wraps
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
LONG_WORD = 48


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * M2
    x = (x ^ (x >> U(27))) * M3
    return x ^ (x >> U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the ordered pairs (a, b)."""
    return mix(a * M1 + (b ^ (b >> U(32))) * M2 + U(1))


def tidy() -> None:
    """At a task's end: give back what Arrow and the C library keep for later, as a worker idles between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(work: Callable) -> Callable:
    """A function of batches (or of a group's tables) that tidies up behind itself."""

    @wraps(work)
    def batches(it):
        try:
            yield from work(it)
        finally:
            tidy()

    @wraps(work)
    def group(table):
        try:
            return work(table)
        finally:
            tidy()

    @wraps(work)
    def groups(left, right):
        try:
            return work(left, right)
        finally:
            tidy()

    if work.__code__.co_flags & 0x20:  # a generator
        return batches
    return group if work.__code__.co_argcount == 1 else groups


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # byte where each word begins
    end: np.ndarray  # byte behind it
    first: np.ndarray  # index of each document's first word; one more entry than documents

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def room(self) -> np.ndarray:
        """Words from each word to its document's end, itself included."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start))


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = raw(column)
    if lower:
        data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~blank
    begins = inside.copy()
    begins[1:] &= blank[:-1]
    ends = inside.copy()
    ends[:-1] &= blank[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def word_hashes(w: Words, seed: int = 0) -> np.ndarray:
    """64 bits of each word's bytes; words beyond LONG_WORD bytes by BLAKE2."""
    length = w.end - w.start
    h = np.full(len(length), seed * 2 + 1, U) * M1
    at = np.flatnonzero(length <= LONG_WORD)
    step = 0
    while len(at):
        h[at] = (h[at] ^ w.data[w.start[at] + step]) * M3
        h[at] ^= h[at] >> U(29)
        step += 1
        at = at[length[at] > step]
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(w.data[w.start[i] : w.end[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
    return mix(h)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive entries of h, across documents too (mask by room())."""
    n = len(h)
    if n < k:
        return np.zeros(0, U)
    out, size, block, width = None, 0, h, 1
    while k:
        if k & 1:
            out = block if out is None else pair(out[: n - size - width + 1], block[size:])
            size += width
        k >>= 1
        if k:
            block = pair(block[: len(block) - width], block[width:])
            width *= 2
    return out


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text each; a longer text makes a slice of its own."""
    if not batch.num_rows:
        return
    _, offsets = raw(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield batch.slice(begin, stop - begin)
        begin = stop


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]; 0 where that is empty."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
