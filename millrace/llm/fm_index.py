"""A compressed FM-index over a sequence of symbols, with vectorised backward search.

The text is a concatenation of segments, each ended by a separator.  Suffixes
are sorted by their first ``depth`` symbols (prefix doubling), which suffices
for patterns of up to ``depth`` symbols.  The transform is held in a wavelet
matrix of bit planes with a count for each 64 bits: about ``log2(alphabet)`` times
1.5 bits a symbol, against 64 of the symbols themselves.  Of the suffix array only
what a search asks of it is kept: at each row, a value of its segment, as a code
of 16 or 32 bits.  The sorted suffixes themselves go when the index is built.
"""

from __future__ import annotations

import numpy as np


class Plane:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.counts = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.counts[1:])
        self.zeros = len(bits) - int(self.counts[-1])

    def ones_before(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.counts[word] + np.bitwise_count(below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.height = max(1, int(alphabet - 1).bit_length())
        self.planes = []
        now = symbols
        for level in reversed(range(self.height)):
            bit = ((now >> level) & 1).astype(np.uint8)
            self.planes.append(Plane(bit))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

        # where each symbol's block begins after all planes
        self.starts = self._down(np.arange(alphabet), np.zeros((1, alphabet), np.int64))[0]

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for plane, level in zip(self.planes, reversed(range(self.height)), strict=True):
            ones = plane.ones_before(at)
            at = np.where((symbols >> level) & 1, plane.zeros + ones, at - ones)
        return at

    def ranks(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each symbol, how often it occurs before each of its places (a row of places each)."""
        return self._down(symbols, at) - self.starts[symbols]


class FMIndex:
    """Backward search over segments of symbols (hashes of words)."""

    def __init__(self, segments: np.ndarray, lengths: np.ndarray, depth: int, values: np.ndarray):
        """``segments``: the symbols of all segments, one after another; ``values``: one of each segment."""
        self.depth = depth
        self.symbols, codes = np.unique(segments, return_inverse=True)  # dense codes from 1; 0 ends a segment
        n = len(segments) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = codes + 1
        rank, width = text.copy(), 1
        while True:  # rank: of suffixes by their first ``width`` symbols; those past a separator don't matter
            nxt = np.zeros(n, np.int64)
            nxt[: n - width] = rank[width:]
            key = rank * (n + len(self.symbols) + 2) + nxt
            order = np.argsort(key)
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            width *= 2
            if width >= depth or new[-1] == n - 1:
                break
        self.values, codes = np.unique(values, return_inverse=True)
        self.code_of_row = np.repeat(codes.astype(np.min_scalar_type(len(self.values))), lengths + 1)[order]
        self.matrix = WaveletMatrix(text[order - 1], len(self.symbols) + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.symbols) + 1))])
        self.size = n

    @property
    def nbytes(self) -> int:
        """Bytes of what a search needs for each place of the text (not of the alphabet and the values)."""
        return self.code_of_row.nbytes + sum(p.words.nbytes + p.counts.nbytes for p in self.matrix.planes)

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least value in each interval of rows."""
        out = self.code_of_row[lo]
        wide = np.flatnonzero(hi - lo > 1)
        if len(wide):
            begins, which = np.unique(lo[wide], return_inverse=True)
            ends = np.zeros(len(begins), np.int64)
            ends[which] = hi[wide]
            padded = np.append(self.code_of_row, np.iinfo(self.code_of_row.dtype).max)
            out[wide] = np.minimum.reduceat(padded, np.stack([begins, ends], axis=1).ravel())[::2][which]
        return self.values[out]

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Codes of symbols; -1 of those that the index does not have."""
        if not len(self.symbols):
            return np.full(len(symbols), -1)
        at = np.minimum(np.searchsorted(self.symbols, symbols), len(self.symbols) - 1)
        return np.where(self.symbols[at] == symbols, at + 1, -1)

    def extend(self, codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that begin with a code and then what the given intervals begin with."""
        found = self.matrix.ranks(codes, np.stack([lo, hi]))
        return self.first[codes] + found[0], self.first[codes] + found[1]

    def matching(self, codes: np.ndarray, room: np.ndarray, length: int, least_room: int = 1, indexed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search from the places of a streamed text, up to ``length`` symbols.

        ``room``: how many symbols a match that ends at the place may have (the
        place's own included); places with less than ``least_room`` are left out,
        as none that a match of interest ends at.  Returns the matching statistics (the length of
        the longest match that ends there, at most ``length``) and its interval.
        ``indexed``: the streamed text is the index's own, so an interval of one
        suffix is the place itself, and is carried to its full length by that.
        """
        n = len(codes)
        matched, lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        live = np.flatnonzero(room >= least_room)
        for step in range(length):
            live = live[room[live] > step]
            symbol = codes[live - step]
            known = symbol > 0
            live, symbol = live[known], symbol[known]
            if not len(live):
                break
            if step == 0:
                a, b = self.first[symbol], self.first[symbol + 1]
            else:
                a, b = self.extend(symbol, lo[live], hi[live])
            there = b > a
            live = live[there]
            lo[live], hi[live] = a[there], b[there]
            matched[live] = step + 1
            if indexed:
                one = hi[live] - lo[live] == 1
                matched[live[one]] = np.minimum(room[live[one]], length)
                live = live[~one]
        return matched, lo, hi
