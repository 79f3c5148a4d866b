"""What the corpus operators share: durable intermediate tables and Arrow helpers."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.workspace import new_path

#: Bytes of one Arrow batch sent to a Python worker; bounds a worker's memory.
ARROW_BATCH_BYTES = "8m"
#: Rows that a scan holds at once: with 4096, a column of texts is one array of many MB, for which the JVM's heap must grow.
SCAN_ROWS = 512
#: A Python worker that has more bytes in memory gives back what a task has freed.
RELEASED_FROM = 100_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and the scans' batches of this session; returns the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(rows, str(min(int(spark.conf.get(rows)), SCAN_ROWS)))
    return spark


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_below(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths sum to at most ``most``; a longer row stands alone."""
    ends = np.cumsum(lengths)
    start, n = 0, len(lengths)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, stop
        start = stop


def resident() -> int:
    """Bytes that this process has in memory; 0 where the system doesn't say."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except OSError:
        return 0


def tidy(run: Callable) -> Callable:
    """A function for ``mapInArrow`` that, when a task ends, gives the memory it has freed back to the system.

    Workers wait for the next task, and allocators keep what was freed; beside
    the JVM and another worker that is memory which the executor lacks.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if resident() > RELEASED_FROM:
                pa.default_memory_pool().release_unused()
                if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
                    trim(0)

    return tidied


def map_arrow(df: DataFrame, fn: Callable, schema: str, rows: int = 1 << 30) -> DataFrame:
    """``mapInArrow`` for a function of one batch (of at most so many rows) to a list of columns, a batch or None."""
    names = [field.split()[0] for field in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None:
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays(out, names=names)

    return df.mapInArrow(tidy(run), schema)


def int64s(column: pa.Array) -> np.ndarray:
    """An int64 column as numpy; nulls must have been replaced before."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
