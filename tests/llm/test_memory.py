"""What Python workers keep in memory between tasks, and what encoded pieces take."""

import ctypes
import os
import sys

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm._common import map_arrow, prepare
from millrace.llm._tokens import WORDS, Table

KEPT = []


def _bytes():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def _now(batch):
    return [pa.array([os.getpid()]), pa.array([_bytes()])]


def _scattered(batch):
    """Takes 200 MB in small parts, and keeps one of 2000: the allocator's heap can't shrink by itself."""
    parts = [np.ones(1 << 12) for _ in range(6000)]
    KEPT.extend(p[:1] for p in parts[::2000])
    return [pa.array([os.getpid()]), pa.array([_bytes()])]


@pytest.mark.skipif(not sys.platform.startswith("linux") or not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="glibc's allocator")
def test_workers_give_back_what_a_task_has_freed(spark):
    docs = spark.range(0, 8, 1, 8)
    run = lambda f: [(r.pid, r.held) for r in map_arrow(docs, f, "pid long, held long").collect()]
    before = dict(run(_now))
    during = dict(run(_scattered))
    after = dict(run(_now))
    known = set(after) & set(during)
    assert known and max(during.values()) > 200_000_000
    for pid in known:
        assert after[pid] < before.get(pid, min(before.values())) + 60_000_000


def test_a_table_of_pieces_is_compact():
    table, n = Table(), (1 << 18) + 1
    for lo in range(0, n, 1 << 14):
        numbers = np.arange(lo, min(n, lo + (1 << 14)), dtype=np.uint64)
        keys = np.zeros((WORDS, len(numbers)), np.uint64)
        keys[0] = numbers + np.uint64(1)
        table.add(keys, np.ones(len(numbers), bool), numbers.astype(np.uint32), np.ones(len(numbers), np.int64))
    keys = np.zeros((WORDS, n + 1), np.uint64)
    keys[0] = np.arange(1, n + 2)
    entries = table.find(keys)
    assert entries[-1] == -1 and np.array_equal(table.ids[table.at[entries[:-1]]], np.arange(n)) and (table.counts[entries[:-1]] == 1).all()
    assert sum(x.nbytes for x in (table.keys, table.at, table.counts, table.ids, table.slots)) < 95 * n


def test_scans_hold_few_rows_of_texts_at_once(spark):
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(rows)
    try:
        for own, want in ((4096, 512), (100, 100)):
            spark.conf.set(rows, str(own))
            assert prepare(spark).conf.get(rows) == str(want)
    finally:
        spark.conf.set(rows, before)
