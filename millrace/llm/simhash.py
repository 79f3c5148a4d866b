"""SimHash near-duplicates, searched by the generalised pigeonhole principle.

Fingerprints are grouped by value first, so copies cost one row.  The 64 bits
are dealt into four parts of correlated bits.  If two fingerprints differ in at
most ``tau`` bits, then for any thresholds that add up to ``tau - 3`` there is a
part in which they differ by at most the part's threshold.  Each fingerprint
takes the thresholds (-1: not searched) whose estimated candidates, from counts
of all part values, are fewest, found by dynamic programming; it probes the
values within them and verifies whole fingerprints.

A value that too many fingerprints share is refined: those that share it must
also agree (but for tau's share of bits) in one of four parts of the other
bits, and so on, until the value's group is small or all but 15 bits are fixed
(so a group is bounded whatever the data).  A group gives only the links of a spanning forest, never
all its pairs.

Defined results: null and empty texts have fingerprint zero and are linked like
others; texts of fewer words than a shingle are one shingle; a component is
named by its smallest id, nulls aside (null if it has no other); an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import durable, int64s, map_arrow, prepare, tidy
from millrace.llm._text import mix
from millrace.llm.components import stars

PARTS = 4
WIDTH = 64 // PARTS
#: Fingerprints that share a value beyond which it is refined.
MOST_IN_GROUP = 4096
#: A probe costs as much as verifying so many candidates.
PROBE_COST = 40.0
#: Bits fixed level by level: four parts of what is left.
LEVELS = (16, 12, 9, 7, 5)
#: Bits of the longer SimHash, and the longs and columns that hold them.
BITS = 256
LONGS = BITS // 64
CONFIRM = [f"c{k}" for k in range(LONGS)]
#: Rows of which one fingerprint may have this share before its rows are labelled apart; so few can, that they are broadcast.
HOT_SHARE = 1000
#: Fingerprints whose probes a worker makes at once.
EMITTED_AT_ONCE = 2000
_BLOCK = 1 << 15
_OFFSETS = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64) for k in range(LONGS)]


def shingle_hashes(words: list[bytes], n: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the n-word shingles, repeats included; of fewer words, that of the whole sequence."""
    n = min(n, len(words))
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[n - 1 :], strict=False)), np.uint64, len(words) - n + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _BLOCK):
        part = np.ascontiguousarray(hashes[lo : lo + _BLOCK])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(data: bytes, n: int = 3, seed: int = 42) -> int:
    """SimHash over XXH64 of the text's n-word shingles."""
    words = data.lower().split()  # of bytes: A-Z only, and white space 0x09-0x0D and 0x20 only
    return majority(shingle_hashes(words, n, seed)) if words else 0


@dataclass(frozen=True)
class Confirm:
    """Links are confirmed by a longer SimHash of its own shingles, which tells the similarity of the shingle sets.

    Sets of similarity s have a cosine of 2s / (1 + s), so ``BITS`` random bits
    differ in ``BITS * acos(cosine) / pi`` places; a link may have two standard
    deviations more, so that few links of the similarity are lost.
    """

    shingle: int = 5
    similarity: float = 0.8

    @property
    def most(self) -> int:
        p = math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi
        return int(BITS * p + 2 * math.sqrt(BITS * p * (1 - p)))

    def values(self, data: bytes) -> list[int]:
        words = data.lower().split()
        if not words:
            return [0] * LONGS
        hashes = shingle_hashes(words, self.shingle)
        return [majority(mix(hashes + offset)) for offset in _OFFSETS]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, confirm: Confirm | None = None) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) of every row; with ``confirm`` its longs ``c0`` on too."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = [t.as_py() for t in batch.column(1).fill_null("").cast(pa.binary())]
        out = [batch.column(0), pa.array(np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64))]
        if confirm:
            longs = np.array([confirm.values(t) for t in texts], np.uint64).reshape(len(texts), LONGS)
            out += [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in longs.T]
        return out

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(source, run, "doc_id long, fp long" + "".join(f", {c} long" for c in CONFIRM * bool(confirm)))


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, as a number."""
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out.astype(np.int64)


def correlated_parts(classes: DataFrame) -> list[list[int]]:
    """Deals the bits into parts: each part starts with a free bit and takes those most correlated with it."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        x = bits_of(int64s(batch.column(0)).view(np.uint64)).astype(np.float32)
        both = (x.T @ x).astype(np.int64)
        i, j = np.divmod(np.arange(64 * 64), 64)
        return [pa.array(i), pa.array(j), pa.array(both.ravel()), pa.array(np.full(64 * 64, len(x)))]

    rows = map_arrow(classes.select("fp"), run, "i long, j long, both long, n long").groupBy("i", "j").agg(F.sum("both"), F.sum("n")).collect()
    if not rows:
        return [list(range(p * WIDTH, (p + 1) * WIDTH)) for p in range(PARTS)]
    both = np.zeros((64, 64))
    for i, j, c, n in rows:
        both[i, j] = c / n
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    near = np.abs(both - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(near, 0)
    left, parts = list(range(64)), []
    for _ in range(PARTS):
        part = [max(left, key=lambda b: near[b, left].max())]
        left.remove(part[0])
        while len(part) < WIDTH:
            part.append(max(left, key=lambda b: near[b, part].sum()))
            left.remove(part[-1])
        parts.append(sorted(part))
    return parts


def part_counts(classes: DataFrame, parts: list[list[int]]) -> np.ndarray:
    """Number of fingerprints with each value of each part: at most four times 2**16 counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, 1 << WIDTH), np.int64)
        for b in batches:
            fps = int64s(b.column(0)).view(np.uint64)
            for p in range(PARTS):
                total[p] += np.bincount(gather(fps, parts[p]), minlength=1 << WIDTH)
        p, v = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(v), pa.array(total[p, v])], names=["p", "v", "n"])

    found = classes.select("fp").mapInArrow(tidy(run), "p long, v long, n long").groupBy("p", "v").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((PARTS, 1 << WIDTH), np.int64)
    counts[found["p"].to_numpy(), found["v"].to_numpy()] = found["n"].to_numpy()
    return counts


def masks(radius: int) -> np.ndarray:
    """Part values at exactly ``radius`` bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), radius)], np.int64)


def candidate_tables(counts: np.ndarray, tau: int) -> np.ndarray:
    """Estimated cost of each threshold (-1 to tau) at each value of each part."""
    values = np.arange(1 << WIDTH)
    out = np.zeros((PARTS, tau + 2, 1 << WIDTH), np.float32)
    for p in range(PARTS):
        for t in range(tau + 1):
            around = masks(t)
            out[p, t + 1] = out[p, t] + PROBE_COST * (len(around) if t else 0)
            for m in around.tolist():
                out[p, t + 1] += counts[p][values ^ m]
    return out


def allocate(tables: np.ndarray, values: list[np.ndarray], tau: int) -> np.ndarray:
    """Thresholds of each fingerprint's parts, with the least estimated cost; they add up to tau - PARTS + 1."""
    n, goal = len(values[0]), tau - PARTS + 1
    lowest, highest = -PARTS, goal + PARTS
    best = {0: np.zeros(n, np.float32)}
    chosen: list[dict[int, np.ndarray]] = []
    for p in range(PARTS):
        costs = tables[p][:, values[p]]
        nxt: dict[int, np.ndarray] = {}
        pick: dict[int, np.ndarray] = {}
        for s in range(lowest, highest + 1):
            options = [(t, best[s - t] + costs[t + 1]) for t in range(-1, tau + 1) if s - t in best]
            if options:
                stacked = np.stack([c for _, c in options])
                at = stacked.argmin(axis=0)
                nxt[s] = stacked[at, np.arange(n)]
                pick[s] = np.array([t for t, _ in options])[at]
        best = nxt
        chosen.append(pick)
    out = np.zeros((PARTS, n), np.int64)
    total = np.full(n, goal)
    for p in reversed(range(PARTS)):
        for s in np.unique(total).tolist():
            rows = total == s
            out[p, rows] = chosen[p][s][rows]
        total = total - out[p]
    return out


def split_bits(bits: list[int], width: int) -> list[list[int]]:
    """Four parts of the bits, of ``width`` or fewer each."""
    return [bits[i::PARTS][:width] for i in range(PARTS)]


def refined(keys: np.ndarray, fps: np.ndarray, level: int, parts: list[list[int]]) -> list[np.ndarray]:
    """The four keys at the next level of each (key, fingerprint); a key holds the parts taken and their values."""
    out = [np.zeros(len(keys), np.int64) for _ in range(PARTS)]
    paths = np.zeros(len(keys), np.int64)
    rest = keys.copy()
    for width in reversed(LEVELS[:level]):
        paths = paths * PARTS + ((rest >> width) & 3)
        rest >>= width + 2
    width = LEVELS[level]
    for path in np.unique(paths).tolist():
        rows = paths == path
        taken, bits, step = path, list(range(64)), parts
        for lvl in range(level):
            part = step[taken % PARTS]
            taken //= PARTS
            bits = [b for b in bits if b not in part]
            step = split_bits(bits, LEVELS[lvl + 1])
        for j in range(PARTS):
            out[j][rows] = (((keys[rows] << 2) | j) << width) | gather(fps[rows], step[j])
    return out


def sub_radius(tau: int) -> int:
    """If two differ in at most tau bits, they differ in at most so many in one of four parts."""
    return (tau + PARTS) // PARTS - 1 if tau % PARTS == PARTS - 1 else tau // PARTS


def deeper(keys: np.ndarray, fps: np.ndarray, roles: np.ndarray, level: int, parts: list[list[int]], tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys at the next level, the row each is of, and its role there."""
    found, rows, kinds = [], [], []
    at = np.arange(len(keys))
    asks = roles >= 2
    for own in refined(keys, fps, level, parts):
        found.append(own)
        rows.append(at)
        kinds.append(roles)
        for r in range(1, sub_radius(tau) + 1):
            for bits in combinations(range(LEVELS[level]), r):
                found.append(own[asks] ^ sum(1 << b for b in bits))
                rows.append(at[asks])
                kinds.append(np.full(int(asks.sum()), 2))
    return np.concatenate(found), np.concatenate(rows), np.concatenate(kinds)


def _emit(tau: int, parts: list[list[int]], tables: np.ndarray, hot: np.ndarray):
    """Index (role 1) and probe (role 2) rows of each fingerprint; those of hot values at the next level."""
    around = [masks(t) for t in range(tau + 1)]

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        fps = int64s(batch.column(0)).view(np.uint64)
        every = np.arange(len(fps))
        values = [gather(fps, part) for part in parts]
        thresholds = allocate(tables, values, tau)
        keys, whose, roles, levels = [], [], [], []

        def put(p: int, value: np.ndarray, rows: np.ndarray, role: np.ndarray) -> None:
            key = (4 | p) << WIDTH | value
            is_hot = hot[p][value]
            cold = ~is_hot
            found = [(key[cold], rows[cold], role[cold], 1)]
            if is_hot.any():
                k, at, r = deeper(key[is_hot], fps[rows[is_hot]], role[is_hot], 1, parts, tau)
                found.append((k, rows[is_hot][at], r, 2))
            for k, at, r, level in found:
                keys.append(k)
                whose.append(at)
                roles.append(r)
                levels.append(np.full(len(k), level, np.int64))

        for p in range(PARTS):
            put(p, values[p], every, 1 + 2 * (thresholds[p] >= 0))
            for t in range(1, int(thresholds[p].max(initial=0)) + 1):
                rows = every[thresholds[p] >= t]
                put(p, (values[p][rows][:, None] ^ around[t][None, :]).ravel(), np.repeat(rows, len(around[t])), np.full(len(rows) * len(around[t]), 2))
        take = pa.array(np.concatenate(whose))
        return [pa.array(np.concatenate(keys)), pa.array(np.concatenate(roles)), pa.array(np.concatenate(levels)), *(c.take(take) for c in batch.columns)]

    return run


class _Near:
    """Whether members of a group are linked: by fingerprint, or by the longer one."""

    def __init__(self, columns: list[np.ndarray], tau: int, most: int | None):
        self.fps, self.longs, self.tau, self.most = columns[0].view(np.uint64), [c.view(np.uint64) for c in columns[2:]], tau, most

    def __call__(self, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        if self.most is None:
            return np.bitwise_count(self.fps[a] ^ self.fps[b]) <= self.tau
        apart = np.zeros(len(b), np.int64)
        for c in self.longs:
            apart += np.bitwise_count(c[a] ^ c[b])
        return apart <= self.most


def _forest(lo: int, hi: int, nodes: np.ndarray, roles: np.ndarray, near: _Near) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what the group's probes find; each link found is verified."""
    us, vs = [], []
    left = np.arange(lo, hi)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            meets = roles[left] & 1 if roles[u] == 2 else (roles[left] & 2 if roles[u] == 1 else roles[left])
            linked = near(u, left) & (meets > 0)
            if linked.any():
                found = left[linked]
                us.append(np.full(len(found), nodes[u]))
                vs.append(nodes[found])
                queue.extend(found.tolist())
                left = left[~linked]
    return us, vs


def _verify(tau: int, most: int | None):
    """From rows sorted by key: the links of each key's group."""

    def links(keys: np.ndarray, roles: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        us, vs = [], []
        nodes, near = columns[1], _Near(columns, tau, most)
        edges = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1, append=keys[-1] + 1))
        sizes = np.diff(edges)
        size_of = np.repeat(sizes, sizes)
        for k in range(1, 8):  # small groups, all at once
            if len(keys) <= k:
                break
            pair = (keys[k:] == keys[:-k]) & (size_of[k:] <= 8)
            pair &= ((roles[k:] & 1) & (roles[:-k] >> 1) | (roles[:-k] & 1) & (roles[k:] >> 1)) > 0
            a = np.flatnonzero(pair)
            a = a[near(a, a + k)]
            us.append(nodes[a])
            vs.append(nodes[a + k])
        for g in np.flatnonzero(sizes > 8).tolist():
            u, v = _forest(edges[g], edges[g + 1], nodes, roles, near)
            us += u
            vs += v
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            new = [int64s(c) for c in b.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
            if cut:
                yield links(held[0][:cut], held[1][:cut], [h[:cut] for h in held[2:]])
                held = [h[cut:] for h in held]
        if held is not None and len(held[0]):
            yield links(held[0], held[1], held[2:])

    return run


def links(classes: DataFrame, tau: int = 3, confirm: Confirm | None = None) -> DataFrame:
    """Links ``u, v`` between nodes of ``fp, node`` (and the longs to confirm by).

    Without ``confirm`` they connect all within ``tau`` bits.  With it they
    connect what it confirms among all that the probes for ``tau`` find: all
    within ``tau`` bits, and most that are a few bits farther.
    """
    if not 0 <= tau <= 11:
        raise ValueError("tau must be from 0 to 11")
    spark = classes.sparkSession
    columns = ["fp", "node", *(CONFIRM if confirm else [])]
    parts = correlated_parts(classes)
    counts = part_counts(classes, parts)
    tables = spark.sparkContext.broadcast(candidate_tables(counts, tau))  # of a fixed size
    hot = counts > MOST_IN_GROUP

    def emit(batch: pa.RecordBatch) -> list[pa.Array]:
        return _emit(tau, parts, tables.value, hot)(batch)

    schema = "key long, role long, level long" + "".join(f", {c} long" for c in columns)
    rows = map_arrow(classes.select(*columns), emit, schema, EMITTED_AT_ONCE)
    if hot.any():
        rows = durable(rows, "probes")
    done = rows.where("level = 1")
    level = 2
    while hot.any() and level < len(LEVELS):
        these = rows.where(F.col("level") == level)
        large = durable(these.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_IN_GROUP).select("key"), "large")
        if large.isEmpty():
            break
        done = done.union(these.join(large, "key", "left_anti").select(*rows.columns))

        def refine(batch: pa.RecordBatch, level: int = level) -> list[pa.Array]:
            keys, at, roles = deeper(int64s(batch.column(0)), int64s(batch.column(3)).view(np.uint64), int64s(batch.column(1)), level, parts, tau)
            take = pa.array(at)
            return [pa.array(keys), pa.array(roles), pa.array(np.full(len(keys), level + 1)), *(c.take(take) for c in batch.columns[3:])]

        rows = durable(map_arrow(these.join(large, "key", "left_semi").select(*rows.columns), refine, schema, EMITTED_AT_ONCE), "probes")
        level += 1
    if hot.any():
        done = done.union(rows.where(F.col("level") == level))
    grouped = done.select("key", "role", *columns).repartition("key").sortWithinPartitions("key")
    return grouped.mapInArrow(tidy(_verify(tau, confirm.most if confirm else None)), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = 3, confirm: Confirm | None = None) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: components of the links."""
    prepare(docs.sparkSession)
    made = fingerprints(docs, id_col, text_col, shingle, confirm)
    node = F.xxhash64("fp", *CONFIRM) if confirm else F.col("fp")  # equal for copies
    prints = durable(made.withColumn("node", node), "fingerprints")
    columns = ["fp", "node", *(CONFIRM if confirm else [])]
    classes = durable(prints.groupBy(*columns).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    joined = stars(links(classes, tau, confirm), "simhash-stars")
    nodes = joined.select(F.col("u").alias("node"), F.col("v").alias("root")).union(joined.select("v", "v").distinct())
    named = nodes.join(classes.select("node", "least"), "node")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = nodes.join(roots, "root").select("node", "component_id")
    labelled = durable(classes.join(labels, "node", "left").select("node", "n", F.coalesce("component_id", "least").alias("component_id")), "labels")
    # fewer than HOT_SHARE nodes can each have more than that share of all rows
    total = labelled.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(labelled.where(F.col("n") > total // HOT_SHARE + 1).drop("n"))
    rows = prints.select("doc_id", "fp", "node")
    cold = rows.join(hot.select("node"), "node", "left_anti").join(labelled.drop("n"), "node")
    out = rows.join(hot, "node").unionByName(cold)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
