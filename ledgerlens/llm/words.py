"""Vectorised word splitting and hashing over Arrow string columns.

The Python-side operators all start the same way: take the UTF-8 buffer of a
column, find the words of every row without a Python loop, and give each word
a 64-bit hash.  Words are maximal runs of bytes outside a separator table;
bytes of multi-byte characters are never separators, so a word never splits a
code point.  A null row has no words.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Space and the control characters from tab to carriage return.
WHITE = b" \t\n\x0b\x0c\r"
_BASE, _MIX1, _MIX2 = U64(0x9E3779B97F4A7C15 | 1), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept and grown."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 12), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.cumprod(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


def byte_classes(separators: bytes = WHITE, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes separate words, and each byte's random 64-bit value (the same for A-Z and a-z if lower)."""
    apart = np.zeros(256, dtype=bool)
    apart[list(separators)] = True
    values = _TABLE.copy()
    if lower:
        values[65:91] = values[97:123]
    return apart, values


PLAIN = byte_classes()
LOWER = byte_classes(lower=True)


@dataclass
class Words:
    """Words of consecutive rows: starts and ends in data, a hash each, and the first word of each row (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 row offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system: several workers share an executor's memory, and each would keep its peak."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Slices of a batch with about `most` bytes of text each; one row is never split."""
    _, at = buffers(batch.column(column))
    row = 0
    while row < len(at) - 1:
        release()
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield batch.slice(row, end - row)
        row = end
    release()


def hash_spans(data: np.ndarray, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, stretch: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; starts ascend.  Works on stretches of data, so tables and sums stay small and in the cache."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, low + stretch)))
        s, e = starts[i:j] - low, ends[i:j] - low
        size = int(e.max())
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(values[data[low : low + size]] * powers(_BASE, size), out=sums[1:])
        out[i:j] = (sums[e] - sums[s]) * powers(_BASE_INVERSE, size + 1)[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _MIX2)


def split(column: pa.Array, classes: tuple[np.ndarray, np.ndarray] = PLAIN) -> Words:
    """The words of every row of a string column."""
    apart, values = classes
    data, offsets = buffers(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return Words(data, starts, ends, hash_spans(data, values, starts, ends), np.searchsorted(starts, offsets))


def grams(words: Words, n: int, base: np.uint64 = _MIX1) -> tuple[np.ndarray, np.ndarray]:
    """For every word position, the hash of the n words from there and whether they all lie in one row."""
    h, m = words.hashes, len(words.hashes)
    inside = np.zeros(m, dtype=bool)
    out = np.zeros(m, dtype=np.uint64)
    if m >= n:
        acc = h[: m - n + 1].copy()
        for j in range(1, n):
            acc = acc * base + h[j : m - n + 1 + j]
        out[: m - n + 1] = mix(acc)
        end = np.repeat(words.first[1:], np.diff(words.first))
        inside[: m - n + 1] = np.arange(m - n + 1) + n <= end[: m - n + 1]
    return out, inside


@dataclass
class LineSpans:
    """Lines of consecutive rows, split at line feeds: begin and end in data, and the first line of each row (one more at the end)."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray


def line_spans(data: np.ndarray, at: np.ndarray) -> LineSpans:
    """Each row of offsets at has at least one line."""
    rows = len(at) - 1
    cut = np.flatnonzero(data == 10)
    row = np.searchsorted(at, cut, side="right") - 1
    counts = np.bincount(row, minlength=rows) + 1 if rows else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    begin, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    begin[first[:-1]], end[first[1:] - 1] = at[:-1], at[1:]
    begin[np.arange(len(cut)) + row + 1], end[np.arange(len(cut)) + row] = cut + 1, cut
    return LineSpans(begin, end, first)


def sums_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive entries of first."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def code_points_before(data: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte (one more at the end)."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
