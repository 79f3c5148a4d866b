"""Words and hashes of whole Arrow text columns, vectorised over bytes.

Words are the runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 are
the runs ``[^\\x20\\x09-\\x0D]+`` of code points.  Hashes of spans are exact
functions of the spans' bytes (a polynomial modulo 2**64 over random byte
values, then mixed); two different spans collide with probability of about
2**-62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from millrace.llm._common import rows_below

#: Bytes of text handled at once, so that the arrays stay in cache; a longer document stands alone.
BLOCK = 1 << 18

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
IS_LEAD = (np.arange(256) & 0xC0) != 0x80

_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(i: int) -> np.uint64:
    """An odd multiplier for place ``i`` of a sequence."""
    return np.uint64((pow(0xD1342543DE82EF95, i + 1, 1 << 64)) | 1)


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` consecutive hashes (len - n + 1 of them)."""
    size = max(0, len(hashes) - n + 1)
    total = np.zeros(size, dtype=np.uint64)
    for i in range(n):
        total += hashes[i : i + size] * spread(i)
    return mix(total)


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` of ``counts[i]`` each, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Block:
    """Documents ``lo`` to ``hi`` of a batch: ``data`` are their bytes, ``bounds`` their offsets in them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lo: int, hi: int):
        self.data, self.bounds, self.lo, self.hi = data, bounds, lo, hi
        self._sums: np.ndarray | None = None

    def words(self) -> None:
        """Sets ``starts`` and ``ends`` of words, ``first`` (of each document, and the end) and ``inside``."""
        inside = ~IS_SPACE[self.data]
        n = len(inside)
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.bounds] = True
        begins, stops = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | edge[1:-1]
            stops[:-1] &= ~inside[1:] | edge[1:-1]
        self.inside, self.starts, self.ends = inside, np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(self.first)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the spans' bytes (and lengths, which are those of the bytes)."""
        if self._sums is None:
            _grow(len(self.data) + 1)
            self._sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(_VALUES[self.data] * _powers[: len(self.data)], out=self._sums[1:])
        raw = (self._sums[ends] - self._sums[starts]) * _inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_BASE))

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte by document."""
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.bounds])

    def doc_of(self) -> np.ndarray:
        """The document (from 0) of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def blocks(column: pa.Array) -> Iterator[Block]:
    """The column's documents in blocks of at most ``BLOCK`` bytes or one document."""
    data, bounds = raw(column)
    for lo, hi in rows_below(np.diff(bounds), BLOCK):
        part = bounds[lo : hi + 1]
        yield Block(data[part[0] : part[-1]], part - part[0], lo, hi)
