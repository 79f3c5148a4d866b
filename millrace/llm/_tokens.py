"""Encoding with the tokenizers library, with a bounded table of encoded pieces.

A byte-level BPE encodes each pre-token on its own.  No pre-token holds a white
space character after another character, and none holds a letter beside a digit
or a mark (an apostrophe's contraction begins with its apostrophe).  So a text
may be cut there, and the pieces encoded apart give the text's ids.  Pieces
recur, so their ids are kept: texts are cut on their bytes, all of a block at
once, and pieces are looked up by their own bytes, so a hit is exact.  Only
pieces not yet seen reach the library.  Texts for which a cut is not proven safe
(information separators, NUL, special tokens) and tokenizers of other kinds are
encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from millrace.llm._common import rows_below
from millrace.llm._text import mix, raw, runs

#: A task has one core; the library's own threads would each hold memory of their own.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: A worker process keeps the ids of so many pieces, and so many ids, before it begins anew.
KEPT_PIECES, KEPT_IDS = 2_000_000, 1 << 24
#: Bytes of text whose pieces are looked up together.
GROUP_BYTES = 1 << 18
#: Longer pieces (in words of eight bytes) are encoded but not found again.
WORDS = 3
#: Pieces that are encoded joined.
JOINED = 64
#: Entries that are placed anew at once when the table grows.
PLACED = 1 << 16
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def vocabulary(tokenizer: Tokenizer) -> list[str]:
    """Tokens in the order of their ids."""
    known = tokenizer.get_vocab()
    out = [""] * (max(known.values(), default=-1) + 1)
    for token, i in known.items():
        out[i] = token
    return out


def longer(array: np.ndarray, used: int, size: int) -> np.ndarray:
    """The array's used places in one of so many; memory beyond them is not touched."""
    out = np.zeros((*array.shape[:-1], size), array.dtype)
    out[..., :used] = array[..., :used]
    return out


class Table:
    """Ids by a piece's bytes, with open addressing; a key is the bytes themselves, padded with zeros."""

    def __init__(self) -> None:
        self.n = self.n_ids = 0
        self.keys = np.zeros((WORDS, 1 << 12), np.uint64)
        self.at = np.zeros(1 << 12, np.uint32)
        self.counts = np.zeros(1 << 12, np.uint32)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.slots = np.full(1 << 13, -1, np.int32)

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        h = keys[0] * np.uint64(0x9E3779B97F4A7C15)
        for k in keys[1:]:
            h = (h ^ (h >> np.uint64(29)) ^ k) * np.uint64(0xBF58476D1CE4E5B9)
        return mix(h)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        last = len(self.slots) - 1
        out = np.full(keys.shape[1], -1, np.int64)
        todo, at = np.arange(keys.shape[1]), (self._hash(keys) & np.uint64(last)).astype(np.int64)
        while len(todo):
            entry = self.slots[at]
            used = entry >= 0
            same = used.copy()
            for k in range(WORDS):
                same &= self.keys[k][entry] == keys[k]
            out[todo[same]] = entry[same]
            on = used & ~same
            todo, at, keys = todo[on], (at[on] + 1) & last, keys[:, on]
        return out

    def _place(self, entries: np.ndarray) -> None:
        last = len(self.slots) - 1
        at = (self._hash(self.keys[:, entries]) & np.uint64(last)).astype(np.int64)
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]
            on = self.slots[at] != entries
            entries, at = entries[on], (at[on] + 1) & last

    def add(self, keys: np.ndarray, found: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """New entries, one after another in ``ids``; the keys (of those ``found`` by them) are distinct and not there."""
        entries = np.arange(self.n, self.n + len(counts))
        size = len(self.at)
        while self.n + len(counts) > size:
            size *= 2
        if size > len(self.at):
            for name in ("keys", "at", "counts"):
                setattr(self, name, longer(getattr(self, name), self.n, size))
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = longer(self.ids, self.n_ids, len(self.ids) + max(len(self.ids), len(ids)))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.at[entries], self.counts[entries], self.keys[:, entries] = self.n_ids + np.cumsum(counts) - counts, counts, keys
        self.n, self.n_ids = self.n + len(counts), self.n_ids + len(ids)
        if 2 * self.n > len(self.slots):
            held = self.slots[self.slots >= 0]
            self.slots = np.full(1 << (2 * self.n - 1).bit_length(), -1, np.int32)
            for lo in range(0, len(held), PLACED):
                self._place(held[lo : lo + PLACED].astype(np.int64))
        self._place(entries[found])
        return entries


def joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts


def holding(marks: list[bytes], data: bytes, bounds: np.ndarray) -> set[int]:
    """The texts (by number) that hold one of the marks."""
    found = set()
    for mark in marks:
        at = data.find(mark)
        while at >= 0:
            i = int(np.searchsorted(bounds, at, "right")) - 1
            found.add(i)
            at = data.find(mark, int(bounds[i + 1]))
    return found


class Pieces:
    """Encodes texts by pieces, and keeps the ids of those in use."""

    def __init__(self, tokenizer: Tokenizer, cuts: bool):
        """``cuts``: texts may be cut where ``begins`` says; else they are encoded whole."""
        self.tokenizer, self.cuts, self.table = tokenizer, cuts, Table()

    def uncut(self, data: bytes, bounds: np.ndarray) -> Iterable[int]:
        """The texts (by number) that must be encoded whole."""
        raise NotImplementedError

    def begins(self, data: np.ndarray) -> np.ndarray:
        """Whether a piece may begin at each byte (of the first, and of a text's first, it does)."""
        raise NotImplementedError

    def learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, one after another, and how many each has."""
        raise NotImplementedError

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts encoded whole, one after another, and how many each has."""
        return joined([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def learn_joined(self, new: list[bytes], simple: list[bool], groups_of: Callable[[list[list[bytes]]], list[list[int]]], parts: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces of which the simple ones are encoded joined; ``parts`` gives a group's ids and how many each of its pieces has."""
        order, ids, counts = [], [], []
        rest = [i for i, s in enumerate(simple) if not s]
        some = [i for i, s in enumerate(simple) if s]
        groups = [some[k : k + JOINED] for k in range(0, len(some), JOINED)]
        for g, of_group in zip(groups, groups_of([[new[i] for i in g] for g in groups]), strict=True):
            own, n = parts(np.array(of_group, np.uint32))
            if len(n) == len(g):
                order += g
                ids.append(own)
                counts.append(n)
            else:
                rest += g
        own, n = self.whole([new[i].decode() for i in rest])
        ids, counts = np.concatenate([*ids, own]), np.concatenate([*counts, n])
        back = np.argsort(np.array(order + rest, np.int64))
        return ids[runs((np.cumsum(counts) - counts)[back], counts[back])], counts[back]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes an id."""
        ids, bounds = self.encode_column(pa.array(texts, pa.string()))
        data, at = ids.astype("<u4", copy=False).tobytes(), (4 * bounds).tolist()
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (and the end); a null is empty."""
        data, bounds = raw(column)
        found = [np.zeros(0, np.uint32)]
        counts = [np.zeros(0, np.int64)]
        for lo, hi in rows_below(np.diff(bounds), GROUP_BYTES):
            ids, n = self._group(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            found.append(ids)
            counts.append(n)
        return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def _group(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = data.tobytes()
        if not self.cuts:
            return self.whole([text[a:b].decode() for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)])
        odd = sorted({*self.uncut(text, bounds), *holding([b"\0"], text, bounds)})  # keys are padded with NUL
        if self.table.n > KEPT_PIECES or self.table.n_ids > KEPT_IDS:
            self.table = Table()
        begins = self.begins(data)
        begins[bounds[:-1][bounds[:-1] < len(data)]] = True
        for i in odd:
            begins[bounds[i] : bounds[i + 1]] = False
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        for i in reversed(odd):  # a whole text is no piece
            ends[np.searchsorted(starts, bounds[i]) - 1 : np.searchsorted(starts, bounds[i])] = bounds[i]
        entry = self._entries(data, text, starts, ends)
        first = np.searchsorted(starts, bounds)
        sizes = self.table.counts[entry].astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(sizes)])[first]
        ids = self.table.ids[runs(self.table.at[entry].astype(np.int64), sizes)]
        n = np.diff(sums)
        if odd:
            own, counts = self.whole([text[bounds[i] : bounds[i + 1]].decode() for i in odd])
            n[odd] = counts
            ids = np.insert(ids, np.repeat(sums[odd], counts), own)
        return ids, n

    def _entries(self, data: np.ndarray, text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's entry of each piece."""
        lengths = ends - starts
        padded = np.concatenate([data, np.zeros(8 * (WORDS + 1), np.uint8)])
        eights = np.ndarray(len(data) + 8 * WORDS, "<u8", padded, strides=(1,))
        keys = np.zeros((WORDS, len(starts)), np.uint64)
        keys[0] = eights[starts] & _MASKS[np.minimum(lengths, 8)]
        for k in range(1, WORDS):
            more = np.flatnonzero(lengths > 8 * k)
            keys[k, more] = eights[starts[more] + 8 * k] & _MASKS[np.minimum(lengths[more] - 8 * k, 8)]
        short = lengths <= 8 * WORDS
        entry = np.full(len(starts), -1, np.int64)
        entry[short] = self.table.find(keys[:, short])
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            pieces = [text[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)]
            number: dict[bytes, int] = {}
            which = np.fromiter((number.setdefault(p, len(number)) for p in pieces), np.int64, len(pieces))
            new = list(number)
            one = np.zeros(len(new), np.int64)  # a place of each
            one[which[::-1]] = missing[::-1]
            entry[missing] = self.table.add(keys[:, one], short[one], *self.learn(new))[which]
        return entry


_SPACE, _ALPHA, _DIGIT, _MARK, _QUOTE, _OTHER = range(6)


def _classes() -> np.ndarray:
    """The class of each byte; those of letters of two bytes come from ``_LETTERS``."""
    out = np.full(256, _OTHER, np.uint8)
    for b in range(33, 127):
        out[b] = _ALPHA if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _QUOTE if chr(b) == "'" else _MARK
    out[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
    return out


_CLASS = _classes()
#: Letters of the Latin, Greek and Cyrillic blocks, by code point.
_LETTERS = np.array([0xC0 <= c < 0x500 and unicodedata.category(chr(c))[0] == "L" for c in range(0x800)])
#: A piece of a single pre-token: an optional space, then letters, digits or marks alone.
_PLAIN = re.compile(f" ?(?:[a-zA-Z{''.join(chr(c) for c in np.flatnonzero(_LETTERS))}]+|[0-9]+|[!-&(-/:-@\\[-`{{-~]+)").fullmatch
#: White space beyond ASCII: lead byte, then the bytes after it.  Fixed values.
_WIDE_SPACES = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", *(bytes([0xE2, 0x80, b]) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\xe2\x81\x9f", b"\xe3\x80\x80"]


def _cut_before() -> np.ndarray:
    """Whether a piece begins between a byte of one class and a byte of another (by 8 times the first plus the second)."""
    out = np.zeros(64, bool)
    for a in range(6):
        for b in range(6):
            spaces = b == _SPACE and a != _SPACE
            kinds = a in (_ALPHA, _DIGIT) and b in (_ALPHA, _DIGIT, _MARK, _QUOTE) and a != b
            marks = a == _MARK and b in (_ALPHA, _DIGIT)
            out[8 * a + b] = spaces or kinds or marks
    return out


_CUT = _cut_before()


class Encoder(Pieces):
    """Ids of a byte-level BPE (or, uncut, of any tokenizer file) as little-endian unsigned 32-bit integers."""

    _known: dict[str, Encoder] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        cuts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec["model"]["type"] == "BPE" and not any(
            t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", [])
        )
        self.odd = [t["content"].encode() for t in spec.get("added_tokens", [])] + [bytes([b]) for b in (0x1C, 0x1D, 0x1E, 0x1F)]
        tokenizer = Tokenizer.from_file(path)
        super().__init__(tokenizer, cuts)
        self.size = len(vocabulary(tokenizer))
        if cuts:
            # bytes as the vocabulary writes them; joined pieces are parted at line breaks, which none of them has
            letters = [pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0] for b in range(128)]
            self.chars = {b: letters[b] for b in range(128)} | {b: _high(b) for b in range(128, 256)}
            self.parted = Tokenizer(tokenizer.model)  # the same vocabulary and merges, held once
            self.parted.pre_tokenizer = pre_tokenizers.Split(self.chars[10], "isolated")
            self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for each path in a process."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def uncut(self, data: bytes, bounds: np.ndarray) -> set[int]:
        return holding(self.odd, data, bounds)

    def begins(self, data: np.ndarray) -> np.ndarray:
        kinds = _CLASS[data]
        lead = np.flatnonzero((data >= 0xC3) & (data < 0xD4))
        lead = lead[: len(lead) - (len(lead) > 0 and lead[-1] == len(data) - 1)]
        known = lead[_LETTERS[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]]
        kinds[known] = kinds[known + 1] = _ALPHA
        text = None
        for some in np.unique(data[(data == 0xC2) | (data >= 0xE1) & (data <= 0xE3)]).tolist():
            text = text or data.tobytes()
            for space in _WIDE_SPACES:
                at = text.find(space) if space[0] == some else -1
                while at >= 0:
                    kinds[at : at + len(space)] = _SPACE
                    at = text.find(space, at + len(space))
        out = np.ones(len(data), bool)
        out[1:] = _CUT[(kinds[:-1] << 3) + kinds[1:]]
        return out

    def learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        def groups_of(groups: list[list[bytes]]) -> list[list[int]]:
            written = [b"\n".join(g).decode("latin-1").translate(self.chars) for g in groups]
            return [e.ids for e in self.parted.encode_batch_fast(written, add_special_tokens=False)]

        def parts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            line = ids == self.line[0]
            return ids[~line], np.diff(np.flatnonzero(line), prepend=-1, append=len(ids)) - 1

        return self.learn_joined(new, [len(self.line) == 1 and _PLAIN(p.decode()) is not None for p in new], groups_of, parts)


def _high(b: int) -> str:
    """How a byte-level vocabulary writes a byte from 128 on: itself where it is a printable character, else the next of those from 0x100 on."""
    spare = [x for x in range(256) if not (33 <= x < 127 or 161 <= x < 256 and x != 173)]
    return chr(0x100 + spare.index(b)) if b in spare else chr(b)
