"""Best-fit packing: documents into as few sequences of bounded length as possible.

Hierarchical residual packing.  Each partition encodes its documents and packs
their pieces best-fit, longest first.  Bins that are nearly full are final;
the others go on as items of their own size (a bin number and a fill, no
tokens), which fewer, larger groups pack best-fit again, until one group is
left or a round no longer merges.  A task holds at most ``PER_TASK`` bins.

Defined results: a null text is empty (its piece is the end id alone); an empty
table gives no rows; repeated rows and equal ids are packed row by row; rows
with a null id keep it.  Only the named columns are read, so others may have
any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import durable, int64s, prepare, tidy
from millrace.llm._tokens import Encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, bin_fill long"
#: Underfull bins that one task of a merging round takes.
PER_TASK = 200_000


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item: longest first, each into the fullest bin that has room."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, n = 0, 0  # free: bit r is set if a bin has room r
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        if fits := free >> size:
            room = size + (fits & -fits).bit_length() - 1
            chosen = rooms[room].pop()
            if not rooms[room]:
                free ^= 1 << room
        else:
            room, chosen, n = capacity, n, n + 1
        bins[i], offsets[i] = chosen, capacity - room
        if left := room - size:
            rooms[left].append(chosen)
            free |= 1 << left
    return bins, offsets


def fills(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fill of each item's bin."""
    return np.bincount(bins, weights=sizes).astype(np.int64)[bins] if len(bins) else bins


def cut(ids: np.ndarray, bounds: np.ndarray, max_len: int, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of documents whose ids stand one after another: the row of each, and ``piece, start, length, ids_crc32`` of each."""
    n = np.diff(bounds)
    whole = np.insert(ids, bounds[1:], end_id).astype("<u4", copy=False)
    lengths = n + 1
    many = -(-lengths // max_len)
    rows = np.repeat(np.arange(len(n)), many)
    piece = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
    first = (lengths - 1) % max_len + 1  # only a document's first piece may be shorter
    start = np.where(piece > 0, first[rows] + (piece - 1) * max_len, 0)
    length = np.where(piece > 0, max_len, first[rows])
    at = start + (np.cumsum(lengths) - lengths)[rows]
    data = memoryview(whole.tobytes())
    crc = [zlib.crc32(data[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True)]
    return rows, np.stack([piece, start, length, np.array(crc, np.int64)]) if len(rows) else np.zeros((4, 0), np.int64)


def _pieces(tokenizer_path: str, max_len: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path)
        ids: list[pa.Array] = []
        numbers: list[np.ndarray] = []
        for batch in batches:
            rows, found = cut(*encoder.encode_column(batch.column(1)), max_len, end_id)
            numbers.append(found)
            ids.append(batch.column(0).take(pa.array(rows, pa.int64())))
        if not numbers:
            return
        table = np.concatenate(numbers, axis=1)
        bins, offsets = best_fit(table[2], max_len)
        fill = fills(bins, table[2])
        bins += TaskContext.get().partitionId() << 34
        columns = [pa.chunked_array(ids).combine_chunks(), pa.array(table[0].astype(np.int32)), *(pa.array(c) for c in (*table[1:], bins, offsets, fill))]
        whole = pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PIECES.split(", ")])
        for at in range(0, whole.num_rows, 10_000):
            yield whole.slice(at, 10_000)

    return run


def _merge(max_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_batches = list(batches)
        if not all_batches:
            return
        bins, sizes = (np.concatenate([int64s(b.column(i)) for b in all_batches]) for i in (0, 1))
        order = np.argsort(bins)  # whatever order the shuffle gave
        bins, sizes = bins[order], sizes[order]
        into, shift = best_fit(sizes, max_len)
        names = np.zeros(into.max(initial=-1) + 1, np.int64)
        names[into[shift == 0]] = bins[shift == 0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bins, names[into], shift, fills(into, sizes))], names=["bin", "into", "shift", "fill"])

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", slack: int | None = None
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document's ids end with ``end_id``; a document longer than ``max_len`` is
    cut so that all pieces but the first have ``max_len`` ids.  A bin with less
    than ``slack`` room (default: a 128th) counts as nearly full.
    """
    prepare(docs.sparkSession)
    slack = max_len // 128 if slack is None else slack
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = durable(source.mapInArrow(tidy(_pieces(tokenizer_path, max_len, end_id)), PIECES), "pieces")
    open_bins = pieces.where((F.col("offset") == 0) & (F.col("bin_fill") <= max_len - slack)).select("bin", F.col("bin_fill").alias("fill"))
    moves = None
    n = open_bins.count()
    while n > 1:
        groups = -(-n // PER_TASK)
        merged = durable(open_bins.repartition(groups, F.xxhash64("bin")).mapInArrow(tidy(_merge(max_len)), "bin long, into long, shift long, fill long"), "bins")
        step = merged.select(F.col("bin").alias("from_bin"), F.col("into").alias("next"), F.col("shift").alias("more"))
        if moves is None:
            moves = step.select(F.col("from_bin").alias("bin"), F.col("next").alias("into"), F.col("more").alias("shift"))
        else:
            moves = moves.join(step, moves["into"] == step["from_bin"], "left").select(
                "bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
            )
        open_bins = merged.where((F.col("shift") == 0) & (F.col("fill") <= max_len - slack)).select(F.col("into").alias("bin"), "fill")
        before, n = n, open_bins.count()
        if groups == 1 or n > 0.95 * before:
            break
    if moves is None:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    return pieces.join(moves.withColumnRenamed("into", "final"), "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("final", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )
