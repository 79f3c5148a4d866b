"""Sharding into ranges of near-equal bytes by histogram sort.

The sort key is (hash of the text, hash of the id and the row's place in the
table of sizes), so equal texts are neighbours, and keys spread evenly and are
distinct even where rows repeat.  The exact bytes below candidate boundaries are counted over all partitions; each
splitter's interval shrinks to the two candidates around its target, until one
is within the tolerance or the interval holds a single row.  The final
boundaries, with finer ones inside each shard, are counted, and what still has
too many rows is cut again, within the keys that it holds, and counted; then
the rows are exchanged once, straight to their range, and a row's slot is its
range's first slot plus its place in the range.

The driver holds boundaries and their counts only: a number fixed by the number
of shards and ranges.

Defined results: a null text has no bytes (size 8) and hashes as empty; repeated
rows are ordered arbitrarily but kept, and a boundary may fall among them; an
empty table gives no rows.  Only the named columns are read.  With more shards than
rows some shards are empty.  Equal texts share a shard unless a boundary must
fall among them for the sizes to be near equal.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import durable, int64s, map_arrow, prepare, tidy

#: Candidate boundaries tried for each splitter in a round.
PROBES = 32
#: Rows of one range of the final exchange, about.
RANGE_ROWS = 1_000_000
MOST_ROUNDS = 64

LOWEST, HIGHEST = -(2**63), 2**63 - 1

Key = tuple[int, int]


def _number(key: Key) -> int:
    """A key as one number, in the same order."""
    return ((key[0] - LOWEST) << 64) + (key[1] - LOWEST)


def _key(number: int) -> Key:
    return (number >> 64) + LOWEST, (number & (2**64 - 1)) + LOWEST


def ranks(keys: list[Key], high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How many of the sorted keys are at or below each row's key."""
    first = np.array([k[0] for k in keys], np.int64)
    left, right = np.searchsorted(first, high, "left"), np.searchsorted(first, high, "right")
    out = left.copy()
    second = np.array([k[1] for k in keys], np.int64)
    tied = np.flatnonzero(left < right)
    if len(tied):
        for value in np.unique(left[tied]).tolist():
            rows = tied[left[tied] == value]
            out[rows] = value + np.searchsorted(second[value : right[rows[0]]], low[rows], "right")
    return out


def count_between(rows: DataFrame, keys: list[Key]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of the len(keys) + 1 intervals between sorted keys: exact bytes and rows, least and greatest first parts."""
    names = ["i", "size", "n", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, n = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64)
        low, high = np.full(len(keys) + 1, HIGHEST), np.full(len(keys) + 1, LOWEST)
        for b in batches:
            first = int64s(b.column(0))
            at = ranks(keys, first, int64s(b.column(1)))
            np.add.at(size, at, int64s(b.column(2)))
            n += np.bincount(at, minlength=len(n))
            np.minimum.at(low, at, first)
            np.maximum.at(high, at, first)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, size[some], n[some], low[some], high[some])], names=names)

    counted = rows.select("high", "low", "size").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names)).groupBy("i")
    found = counted.agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    size, n = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64)
    low, high = np.full(len(keys) + 1, HIGHEST), np.full(len(keys) + 1, LOWEST)
    for r in found:
        size[r.i], n[r.i], low[r.i], high[r.i] = r.size, r.n, r.low, r.high
    return size, n, low, high


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[Key]:
    """Boundaries of ``shards`` ranges: a range begins at its boundary.

    Each has bytes below it within ``tolerance`` of a shard of its target, or is
    the best of two neighbouring keys.
    """
    total, heaviest, rows_in_all = rows.agg(F.sum("size"), F.max("size"), F.count(F.lit(1))).first()
    if not total:
        return []
    targets = [total * k / shards for k in range(1, shards)]
    within = tolerance * total / shards
    lo, hi = [0] * len(targets), [1 << 128] * len(targets)  # bytes below lo <= target < bytes below hi
    below, before = {0: 0, 1 << 128: total}, {0: 0, 1 << 128: rows_in_all}  # bytes and rows below each key tried
    open_ = set(range(len(targets)))
    for _ in range(MOST_ROUNDS):
        if not open_:
            break
        probes = set()
        for i in open_:
            width = hi[i] - lo[i]
            # evenly over the interval, and around where an even spread would put the target
            probes.update(lo[i] + width * k // (PROBES + 1) for k in range(1, PROBES + 1))
            span = below[hi[i]] - below[lo[i]]
            guess = lo[i] + int(width * ((targets[i] - below[lo[i]]) / span)) if span else lo[i]
            step = max(1, int(width * min(1.0, heaviest / max(1, span)) / 2))
            probes.update(min(max(guess + j * step, lo[i] + 1), hi[i] - 1) for j in range(-4, 5))
        tried = sorted(p for p in probes if p not in below)
        if tried:
            size, n, low, high = count_between(rows, [_key(p) for p in tried])
            below.update(zip(tried, np.cumsum(size)[:-1].tolist(), strict=True))
            before.update(zip(tried, np.cumsum(n)[:-1].tolist(), strict=True))
        known = sorted(below)
        sums = np.array([below[k] for k in known])
        for i in list(open_):
            at = int(np.searchsorted(sums, targets[i], "right")) - 1
            lo[i], hi[i] = known[at], known[min(at + 1, len(known) - 1)]
            if tried:
                # the rows' own first parts bound the interval: no row lies between the old bound and the new one
                j = bisect.bisect_right(tried, lo[i])
                if low[j] <= high[j]:
                    least, most = max(lo[i], _number((int(low[j]), LOWEST))), min(hi[i], _number((int(high[j]), LOWEST)) + (1 << 64))
                    if least < most:
                        below.setdefault(least, below[lo[i]])
                        before.setdefault(least, before[lo[i]])
                        below.setdefault(most, below[hi[i]])
                        before.setdefault(most, before[hi[i]])
                        lo[i], hi[i] = least, most
            if min(targets[i] - below[lo[i]], below[hi[i]] - targets[i]) <= within or hi[i] - lo[i] <= 1 or before[hi[i]] - before[lo[i]] <= 1:
                open_.discard(i)
        needed = {*lo, *hi}
        below = {k: v for k, v in below.items() if k in needed}
    return [_key(min(lo[i] if t - below[lo[i]] <= below[hi[i]] - t else hi[i], (1 << 128) - 1)) for i, t in enumerate(targets)]


def range_cuts(rows: DataFrame, cuts: list[Key]) -> tuple[list[Key], np.ndarray]:
    """Boundaries, ``cuts`` among them, of ranges of at most twice ``RANGE_ROWS`` rows, and how many rows each range has."""
    many = max(1, math.ceil(rows.count() / RANGE_ROWS))
    known = {*map(_number, cuts), *((1 << 128) * k // many for k in range(1, many))}
    for _ in range(MOST_ROUNDS):
        fine = sorted(known)
        _, n, low, high = count_between(rows, [_key(k) for k in fine])
        edges = [0, *fine, 1 << 128]
        for i in np.flatnonzero(n > 2 * RANGE_ROWS).tolist():
            # the rows' own first parts bound the range
            least, most = max(edges[i], _number((int(low[i]), LOWEST))), min(edges[i + 1], _number((int(high[i]), LOWEST)) + (1 << 64))
            parts = math.ceil(n[i] / RANGE_ROWS)
            known.update(k for k in (least + (most - least) * j // parts for j in range(parts)) if k > 0)
        if len(known) == len(fine):
            break
    return [_key(k) for k in fine], n


def shard_rows(rows: DataFrame, shards: int, tolerance: float = 0.002) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows that have ``high, low, size`` (a durable table: it is read several times)."""
    cuts = splitters(rows, shards, tolerance)
    fine, n = range_cuts(rows, cuts)
    # range r holds keys from fine[r - 1]; a shard begins at each of its cuts
    starts = [_number(c) for c in cuts]
    shard = np.array([0, *(sum(s <= _number(f) for s in starts) for f in fine)], np.int64)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    begin = np.array([first[np.searchsorted(shard, s)] for s in shard], np.int64)
    offset = first - begin

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = ranks(fine, int64s(batch.column("high")), int64s(batch.column("low")))
        return batch.append_column("range_no", pa.array(at.astype(np.int64)))

    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            at = int64s(b.column("range_no"))
            slots = np.zeros(len(at), np.int64)
            for r in np.unique(at).tolist():
                here = at == r
                slots[here] = offset[r] + seen.get(r, 0) + np.arange(here.sum())
                seen[r] = seen.get(r, 0) + int(here.sum())
            yield b.append_column("shard", pa.array(shard[at])).append_column("slot", pa.array(slots))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ranged = rows.mapInArrow(tidy(lambda it: (place(b) for b in it)), f"{schema}, range_no long")
    exchanged = ranged.repartitionById(len(fine) + 1, F.col("range_no").cast("int")).sortWithinPartitions("high", "low")
    return exchanged.mapInArrow(tidy(slot), f"{schema}, range_no long, shard long, slot long")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every document; size is its UTF-8 bytes plus 8."""
    prepare(docs.sparkSession)
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "utf-8")), F.lit(0)).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("high"),
        F.xxhash64(F.col(id_col).cast("long"), F.monotonically_increasing_id()).alias("low"),
    )
    placed = shard_rows(durable(rows, "sizes"), shards, tolerance)
    return placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
