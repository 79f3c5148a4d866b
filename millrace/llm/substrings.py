"""Substring dedup: words in a run of words that an earlier document has as well.

A window (13 consecutive words) is removed from a document if a document of
smaller id has a window of the same words.  Windows are found by matching
statistics over compressed FM-indexes, one per shard.

Sharding.  A window's anchor is the least hash of its nine runs of five words,
so equal windows have equal anchors, and neighbouring windows mostly share one.
Anchors that a single document has cannot be in a repeated window; the others
are counted and joined back, and only their windows go on, as segments of words
around one anchor, to the shard of the anchor.  An anchor that very many
documents have sends its windows one by one, each to the shard of its own hash,
so it does not fill a shard.  Equal segments are merged before the exchange,
keeping the least id, and sent compressed.

In a shard, the distinct segments are indexed and then streamed through the
index: backward search over the wavelet matrix gives, for each place, how much
of what ends there the shard has, and the interval of suffixes; where that
reaches the window's length, the least id over the interval decides.  Results
return to the documents by segment.

The text is exchanged once; anchors are 64-bit hashes, words within a shard
are compared by 64-bit hashes (a wrong match needs a collision in an otherwise
equal window), segments by 128-bit hashes.

Defined results: a null or empty text has no words; a text of fewer words than
a window loses none; rows of equal id don't remove each other's words, and
rows of equal id and text have equal results; a null id counts as larger than
any; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import durable, int64s, map_arrow, prepare, tidy
from millrace.llm._text import Block, blocks, combine, mix, runs
from millrace.llm.fm_index import FMIndex

WINDOW = 13
ANCHOR = 5
#: Documents with an anchor beyond which its windows are sharded one by one.
HOT = 1000
#: Words of a shard, about.
SHARD_WORDS = 150_000
#: Shards whose segments one task of the exchange takes.
SHARDS_PER_TASK = 8
#: Bits of the set of shared anchors that tasks hold: a fixed size.  It only saves sending anchors that no join would keep.
BITMAP_BITS = 1 << 26
HIGHEST = 2**63 - 1
#: Bytes of segments that wait in a task until equal ones are merged.
MERGED_BYTES = 64_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def anchors(block: Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word, document and anchor of every window of the block."""
    block.words()
    words = block.span_hash(block.starts, block.ends)
    size = len(words) - window + 1
    if size <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64)
    runs = combine(words, min(ANCHOR, window))
    least = runs[:size].copy()
    for i in range(1, window - min(ANCHOR, window) + 1):
        np.minimum(least, runs[i : i + size], out=least)
    doc = block.doc_of()
    whole = np.flatnonzero(doc[window - 1 :] == doc[:size])
    return whole, doc[whole], least[whole]


def bitmap(keys: DataFrame) -> np.ndarray:
    """A set of hashes of the column ``a``, of a fixed size: it may hold more, and holds all."""
    at = F.pmod(F.col("a"), F.lit(BITMAP_BITS))
    words = keys.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(a, 64) AS INT))")).alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.uint64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(BITMAP_BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _anchor_rows(window: int, known: Broadcast | None = None):
    """Anchors of each document; with a bitmap, only those that it may hold."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        found, rows = [], []
        for block in blocks(batch.column(2)):
            _, doc, anchor = anchors(block, window)
            new = np.ones(len(doc), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            if known is not None:
                new &= in_bitmap(known.value, anchor)
            found.append(anchor[new].view(np.int64))
            rows.append(doc[new] + block.lo)
        take = pa.array(np.concatenate(rows))
        return [pa.array(np.concatenate(found)), batch.column(0).take(take), batch.column(1).take(take)]

    return run


def sequence_ids(words: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """128-bit hashes (two rows) of runs of words, from the words' hashes."""
    out = np.zeros((2, len(starts)), np.uint64)
    for row, base in zip(out, _BASES, strict=True):
        powers, inverse = (np.cumprod(np.full(len(words) + 1, b, np.uint64)) for b in (base, pow(base, -1, 1 << 64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + np.uint64(base)) * powers[: len(words)])])
        row[:] = mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64) * _ODD)
    return out


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in an order in which equal ones stand together, where each group of equals begins in it, and each group's first row."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    edges = np.flatnonzero(new)
    return order, edges, order[edges]


class Spans:
    """Segments of a block of documents: runs of words around shared anchors."""

    def __init__(self, block: Block, row: np.ndarray, first: np.ndarray, stop: np.ndarray, key: np.ndarray, alone: np.ndarray):
        """``row``: of the batch; ``first, stop``: words of the block; ``alone``: a window with a shard of its own."""
        self.row, self.place = row, first - block.first[block.doc_of()[first]]
        self.ids = sequence_ids(block.span_hash(block.starts, block.ends), first, stop)
        self.key = np.where(alone, self.ids[0], key)
        # words with one space after each
        keep = block.inside.copy()
        keep[block.ends[block.ends < len(keep)]] = True
        at = np.concatenate([[0], np.cumsum(keep)])
        text = block.data[keep]
        text[~block.inside[keep]] = 0x20
        self.text, self.begin, self.end = text.tobytes(), at[block.starts[first]], at[block.ends[stop - 1]]


def _segments(batch: pa.RecordBatch, window: int, queries_only: bool) -> Iterator[Spans]:
    """The segments of a batch of documents with their shared anchors, block by block."""
    column = batch.column("shared")
    some = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if not len(some):
        return
    column, texts = column.take(pa.array(some)), batch.column("text").take(pa.array(some))
    flat = column.flatten()
    keys, hot, query = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("a", "hot", "query"))
    owner = np.repeat(np.arange(len(some)), np.diff(column.offsets.to_numpy()))
    if queries_only:
        keys, hot, owner = keys[query], hot[query], owner[query]
    marks = mix(keys.astype(np.int64).view(np.uint64) + owner.astype(np.uint64) * _ODD)
    order = np.argsort(marks)
    marks, hot = marks[order], hot.astype(bool)[order]
    if not len(marks):
        return
    for block in blocks(texts):
        at, doc, anchor = anchors(block, window)
        mark = mix(anchor + (doc + block.lo).astype(np.uint64) * _ODD)
        # an anchor's windows mostly stand together
        change = np.flatnonzero(np.diff(mark, prepend=~mark[:1])) if len(mark) else np.zeros(0, np.int64)
        found = np.minimum(np.searchsorted(marks, mark[change]), len(marks) - 1)
        found = np.repeat(np.where(marks[found] == mark[change], found, -1), np.diff(change, append=len(mark)))
        shared = found >= 0
        if not shared.any():
            continue
        at, doc, anchor, alone = at[shared], doc[shared], anchor[shared], hot[found[shared]]
        new = np.ones(len(at) + 1, bool)
        new[1:-1] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | alone[1:] | alone[:-1]
        edges = np.flatnonzero(new)
        firsts = edges[:-1]
        yield Spans(block, some[block.lo + doc[firsts]], at[firsts], at[edges[1:] - 1] + window, anchor[firsts], alone[firsts])


def _segment_rows(window: int, shards: int):
    """Distinct segments of a batch with the least and greatest ranks that have them, compressed for each task of the exchange."""
    tasks = task_count(shards)

    def run(batch: pa.RecordBatch) -> list[pa.Array] | None:
        ranks = int64s(batch.column("rank"))
        ids, shard, first, last, segments = [], [], [], [], []
        for s in _segments(batch, window, False):
            order, edges, one = distinct(*s.ids)
            rank = ranks[s.row][order]
            ids.append(s.ids[:, one])
            shard.append((mix(s.key[one]) % np.uint64(shards)).astype(np.int64))
            first.append(np.minimum.reduceat(rank, edges))
            last.append(np.maximum.reduceat(rank, edges))
            segments += [s.text[a:b] for a, b in zip(s.begin[one].tolist(), s.end[one].tolist(), strict=True)]
        if not segments:
            return None
        order, edges, one = distinct(*np.concatenate(ids, axis=1))
        shard = np.concatenate(shard)[one]
        first, last = np.minimum.reduceat(np.concatenate(first)[order], edges), np.maximum.reduceat(np.concatenate(last)[order], edges)
        order = np.argsort(shard % tasks, kind="stable")
        edges = np.flatnonzero(np.diff((shard % tasks)[order], prepend=-1, append=-1))
        to, payloads = [], []
        for lo, hi in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            rows = order[lo:hi]
            to.append(int(shard[rows[0]] % tasks))
            payloads.append(packed(shard[rows], first[rows], last[rows], [segments[i] for i in one[rows].tolist()]))
        return [pa.array(to, pa.int32()), pa.array(payloads, pa.binary())]

    return run


def task_count(shards: int) -> int:
    return -(-shards // SHARDS_PER_TASK)


def packed(shard: np.ndarray, first: np.ndarray, last: np.ndarray, segments: list[bytes]) -> bytes:
    """Numbers and words of segments, compressed; the length stands before."""
    data = np.concatenate([[len(segments)], shard, first, last]).astype("<i8").tobytes() + b"\n".join(segments)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, bytes]:
    """A row each of shards, first and last ranks; and the segments, a line each."""
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    return np.frombuffer(data, "<i8", 3 * n, 8).reshape(3, n), data[8 * (3 * n + 1) :]


def _occurrence_rows(window: int):
    def run(batch: pa.RecordBatch) -> list[pa.Array] | None:
        found = list(_segments(batch, window, True))
        if not found:
            return None
        rows = pa.array(np.concatenate([s.row for s in found]))
        ids = np.concatenate([s.ids for s in found], axis=1).view(np.int64)
        return [*(pa.array(x) for x in ids), batch.column("rank").take(rows), batch.column("h").take(rows), pa.array(np.concatenate([s.place for s in found]).astype(np.int32))]

    return run


class Shards:
    """Distinct segments of some shards as sequences of hashes of words, with the least and greatest ranks that have them."""

    def __init__(self) -> None:
        self.numbers, self.counts, self.words = np.zeros((3, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.waiting: list[tuple[np.ndarray, bytes]] = []
        self.size = 0

    def add(self, numbers: np.ndarray, lines: bytes) -> None:
        self.waiting.append((numbers, lines))
        self.size += len(lines) + numbers.nbytes
        if self.size > MERGED_BYTES:
            self.merge()

    def merge(self) -> None:
        """Takes what waits, and merges equal segments of a shard."""
        for numbers, lines in self.waiting:
            data = np.frombuffer(lines, np.uint8)
            text = Block(data, np.concatenate([[0], np.flatnonzero(data == 10), [len(data)]]), 0, 0)
            text.words()
            self.numbers = np.concatenate([self.numbers, numbers], axis=1)
            self.counts = np.concatenate([self.counts, text.counts])
            self.words = np.concatenate([self.words, text.span_hash(text.starts, text.ends)])
        self.waiting, self.size = [], 0
        starts = np.cumsum(self.counts) - self.counts
        ids = sequence_ids(self.words, starts, starts + self.counts)
        order, edges, one = distinct(*ids, self.numbers[0])
        if len(one):
            least, most = np.minimum.reduceat(self.numbers[1][order], edges), np.maximum.reduceat(self.numbers[2][order], edges)
            self.words, self.counts, self.numbers = self.words[runs(starts[one], self.counts[one])], self.counts[one], np.stack([self.numbers[0][one], least, most])

    def each(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Words, lengths, least and greatest ranks of each shard's segments."""
        self.merge()
        starts = np.cumsum(self.counts) - self.counts
        for shard in np.unique(self.numbers[0]).tolist():
            rows = np.flatnonzero(self.numbers[0] == shard)
            yield self.words[runs(starts[rows], self.counts[rows])], self.counts[rows], *self.numbers[1:, rows]


def shard_least(symbols: np.ndarray, counts: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """For each place of a shard's distinct segments, the least rank that has the window that ends there."""
    index = FMIndex(symbols, counts, window, least)
    streamed = index.codes(symbols)
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    matched, lo, hi = index.matching(streamed, place, window, window, indexed=True)
    out = np.full(len(symbols), HIGHEST)
    full = np.flatnonzero(matched >= window)
    out[full] = index.least(lo[full], hi[full])
    return out


LEAST = "id_a long, id_b long, least array<long>"


def _shard_results(window: int):
    """The least ranks of each distinct segment's windows, if one of them is below a rank that has the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Shards()
        for b in batches:
            for payload in b.column(0):
                held.add(*unpacked(payload.as_py()))
        for words, counts, first, last in held.each():
            found = shard_least(words, counts, first, window)
            ends = np.cumsum(counts)
            useful = np.flatnonzero(np.minimum.reduceat(found, ends - counts) < last)
            size = counts[useful] - window + 1
            ids = sequence_ids(words, (ends - counts)[useful], ends[useful]).view(np.int64)
            values = pa.array(found[runs((ends - counts)[useful] + window - 1, size)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in ids), lists], names=["id_a", "id_b", "least"])

    return run


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept(window: int, with_text: bool):
    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column("text").fill_null("").cast(pa.binary()).to_pylist()
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for text, removed in zip(texts, batch.column("removed").to_pylist(), strict=True):
            words = text.split()
            kept = words
            if removed:
                cover = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.array(removed, np.int64))
                cover[at] += 1
                np.subtract.at(cover, at + window, 1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()]
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            if with_text:
                kept_texts.append(b" ".join(kept) if removed else text)
        ids = pa.compute.if_else(batch.column("no_id"), pa.scalar(None, pa.int64()), batch.column("rank"))
        out = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests)]
        if with_text:
            out += [pa.array(kept_texts, pa.binary()).cast(pa.string()), *(c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n.startswith("carry_"))]
        return out

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row.

    With ``carry``, also ``text`` (whole where nothing was removed, else the kept
    words joined by a space) and the columns named.
    """
    spark = prepare(docs.sparkSession)
    key = F.col(id_col).cast("long")
    source = docs.select(
        F.coalesce(key, F.lit(HIGHEST)).alias("rank"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"),
        F.col(text_col).alias("text"),
        key.isNull().alias("no_id"),
        *(F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry or [])),
    )
    texts, anchor_schema = source.select("rank", "h", "text"), "a long, rank long, h long"
    counted = map_arrow(texts, _anchor_rows(window), anchor_schema).groupBy("a").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = durable(counted.where("first < last").select("a", "first", "n"), "anchors")
    total = shared.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total * 12 // SHARD_WORDS))
    found = map_arrow(texts, _anchor_rows(window, spark.sparkContext.broadcast(bitmap(shared))), anchor_schema)
    struct = F.struct("a", (F.col("n") > HOT).alias("hot"), (F.col("first") < F.col("rank")).alias("query"))
    of_doc = found.join(shared, "a").groupBy(F.col("rank").alias("r"), F.col("h").alias("g")).agg(F.collect_set(struct).alias("shared"))
    # the same exchange of whole rows serves all three uses of the texts
    moved = source.repartition("rank", "h")
    joined = moved.join(of_doc, (F.col("rank") == F.col("r")) & (F.col("h") == F.col("g")), "left").drop("r", "g")
    segments = map_arrow(joined, _segment_rows(window, shards), "part int, payload binary")
    sharded = segments.repartitionById(task_count(shards), F.col("part")).select("payload")
    least = sharded.mapInArrow(tidy(_shard_results(window)), LEAST)
    occurrences = map_arrow(joined, _occurrence_rows(window), "id_a long, id_b long, rank long, h long, first int")
    hits = occurrences.join(least, ["id_a", "id_b"]).select("rank", "h", F.expr("transform(filter(transform(least, (x, i) -> IF(x < rank, i, -1)), i -> i >= 0), i -> i + first)").alias("at"))
    removed = hits.where("size(at) > 0").groupBy(F.col("rank").alias("r"), F.col("h").alias("g")).agg(F.flatten(F.collect_list("at")).alias("removed"))
    ended = moved.join(removed, (F.col("rank") == F.col("r")) & (F.col("h") == F.col("g")), "left").drop("r", "g")
    if carry is None:
        return map_arrow(ended, _kept(window, False), OUT)
    kinds = dict(docs.dtypes)
    result = map_arrow(ended, _kept(window, True), f"{OUT}, text string" + "".join(f", carry_{i} {kinds[c]}" for i, c in enumerate(carry)))
    return result.withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)})
