"""Document fingerprints by order min-hash, sensitive to edit distance.

A text's units are its words; longer ones are cut every 32 bytes.  Each k-mer
of units is numbered by its occurrence, so repeats count.  For each of the
signature's hash functions the ``TUPLE`` least numbered k-mers are selected, put
back in text order, and hashed as a tuple.  Two texts agree in a component only
if they share the selected k-mers in the same order.

Defined results: null and empty texts, and texts of white space, have one and
the same signature; fewer units than ``k`` are one k-mer; fewer k-mers than
``TUPLE`` give a shorter tuple.  Rows with equal ids are ordered by a hash of
their texts; a null id comes first; one row is its own next; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import int64s, prepare, tidy
from millrace.llm._text import Block, blocks, combine, mix, spread

K = 2
COMPONENTS = 64
TUPLE = 2
UNIT_BYTES = 32
LOWEST = -(2**63)

_MULTIPLIERS = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 64, COMPONENTS, dtype=np.uint64) | np.uint64(1)
_TOP = np.uint64(2**64 - 1)


def units(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the block's units and the number of units of each document."""
    block.words()
    times = -(-(block.ends - block.starts) // UNIT_BYTES)
    starts, ends = block.starts, block.ends
    counts = block.counts
    if len(times) and times.max() > 1:
        counts = np.bincount(block.doc_of(), weights=times, minlength=len(counts)).astype(np.int64)
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        starts = np.repeat(starts, times) + place * UNIT_BYTES
        ends = np.minimum(starts + UNIT_BYTES, np.repeat(block.ends, times))
    return block.span_hash(starts, ends), counts


def kmers(hashes: np.ndarray, counts: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Numbered k-mers of all documents, and how many each has."""
    many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), many)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + first[doc]
    x = np.zeros(len(at), np.uint64)
    for i in range(k):
        there = i < counts[doc]
        x += np.where(there, hashes[np.minimum(at + i, max(0, len(hashes) - 1))] * spread(i), np.uint64(0)) if len(hashes) else 0
    x = mix(x)
    same = mix(x + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(same, kind="stable")
    group = np.ones(len(order), bool)
    group[1:] = same[order][1:] != same[order][:-1]
    begin = np.flatnonzero(group)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order)) - begin[np.cumsum(group) - 1] if len(order) else 0
    return mix(x + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), many


def signatures(column: pa.Array) -> np.ndarray:
    """A row of 16-bit components for each text."""
    out = np.zeros((len(column), COMPONENTS), np.uint16)
    for block in blocks(column):
        x, many = kmers(*units(block))
        docs = np.flatnonzero(many)
        if not len(docs):
            continue
        many = many[docs]
        first = np.cumsum(many) - many
        for c, multiplier in enumerate(_MULTIPLIERS):
            v = x * multiplier  # a bijection, so a document's numbered k-mers stay apart
            found = np.full((TUPLE, len(docs)), len(x), np.int64)
            for t in range(TUPLE):
                least = np.minimum.reduceat(v, first)
                at = np.flatnonzero(v == np.repeat(least, many))
                whose = np.searchsorted(first, at, "right") - 1
                real = many[whose] > t
                found[t, whose[real]] = at[real]
                v[at] = _TOP
            found.sort(axis=0)  # text order; what is missing comes last
            value = np.full(len(docs), 0x5BF03635, np.uint64)
            for t in range(TUPLE):
                value += np.where(found[t] < len(x), x[np.minimum(found[t], len(x) - 1)], np.uint64(1)) * spread(t)
            out[block.lo + docs, c] = (mix(value) >> np.uint64(48)).astype(np.uint16)
    return out


def as_text(signatures: np.ndarray) -> list[str]:
    width = signatures.shape[1] * 4
    joined = signatures.astype(">u2").tobytes().hex()
    return [joined[i : i + width] for i in range(0, len(joined), width)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(as_text(signatures(b.column(1))))], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(tidy(run), "doc_id long, fingerprint string")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal components, row by row."""
    return (a == b).mean(axis=1)


PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, then rows of the next part: compares each with the one after it."""
    held: tuple | None = None  # the last row, whose next is still to come
    for b in batches:
        texts, ids = b.column(1).fill_null(""), b.column(0)
        guard = b.column(2).to_numpy(zero_copy_only=False) == 1
        n = int(np.argmax(guard)) + 1 if guard.any() else len(guard)  # the first guard ends the part
        ids, texts = ids.slice(0, n).to_pylist(), texts.slice(0, n).to_pylist()
        signs = signatures(pa.array(texts, pa.string()))
        if held:
            ids, texts, signs = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], signs])
        edited = []
        for text, after in zip(texts, texts[1:], strict=False):
            half = len(text) // 2
            edited.append(text[: len(text) - half] + after[:half])
        if edited:
            other = signatures(pa.array(edited, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[:-1], pa.int64()),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array(as_text(signs[:-1])),
                    pa.array(as_text(other)),
                    pa.array(likeness(signs[:-1], other)),
                    pa.array(likeness(signs[:-1], signs[1:])),
                ],
                names=[f.split()[0] for f in PAIRS.split(", ")],
            )
        held = ids[-1], texts[-1], signs[-1:]
        if guard.any():
            return


def range_cuts(quantiles: list[int]) -> list[tuple[int, int]]:
    """Boundaries (key, hash) from sorted quantiles of the keys; a key that several quantiles name is cut by the hash as often."""
    times: dict[int, int] = {}
    for q in quantiles:
        times[q] = times.get(q, 0) + 1
    return [(q, LOWEST + (1 << 64) * k // n) for q, n in sorted(times.items()) for k in range(n)]


def part_of(cuts: list[tuple[int, int]]) -> Column:
    """How many of the sorted boundaries are at or below a row's (key, h), by a search in two steps."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    below = lambda c: (c["key"] < F.col("key")) | (c["key"] == F.col("key")) & (c["h"] <= F.col("h"))
    of = lambda some: F.arrays_zip(F.lit([k for k, _ in some]).cast("array<bigint>").alias("key"), F.lit([h for _, h in some]).cast("array<bigint>").alias("h"))
    coarse = F.size(F.filter(of(cuts[::step]), below))
    fine = F.size(F.filter(F.slice(of(cuts), (coarse - 1) * step + 1, F.lit(step)), below))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine).cast("int")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and its likeness to that and to the next row's.

    Rows are exchanged once, to ranges of ids (and of hashes of the texts, where
    many have one id or none); the first row of each range goes to the range
    before it as well (the last range's next is the first's first).
    """
    spark = prepare(docs.sparkSession)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    cuts = range_cuts(rows.select(F.percentile_approx("key", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0] or [])[: parts - 1]
    rows = rows.withColumn("part", part_of(cuts))
    firsts = dict(rows.groupBy("part").agg(F.min(F.struct("key", "h")).alias("f")).collect())
    if not firsts:
        return spark.createDataFrame([], PAIRS)
    there = sorted(firsts)
    before = dict(zip(there, [there[-1], *there], strict=False))
    whole = range(len(cuts) + 1)
    longs = lambda values: F.lit(list(values)).cast("array<bigint>")
    of_part = lambda values: F.element_at(longs(values), F.col("part") + 1)
    own = F.struct(F.col("part").alias("to"), F.lit(0).alias("guard"))
    other = F.struct(of_part(before.get(p, 0) for p in whole).cast("int").alias("to"), F.lit(1).alias("guard"))
    is_first = (of_part(firsts[p].key if p in firsts else 0 for p in whole) == F.col("key")) & (of_part(firsts[p].h if p in firsts else 0 for p in whole) == F.col("h"))
    sent = rows.withColumn("place", F.explode(F.when(is_first, F.array(own, other)).otherwise(F.array(own)))).select("doc_id", "text", F.col("place.guard").alias("guard"), "key", "h", "place.to")
    moved = sent.repartitionById(len(cuts) + 1, F.col("to")).sortWithinPartitions("guard", "key", "h").select("doc_id", "text", "guard")
    return moved.mapInArrow(tidy(_pairs), PAIRS)
