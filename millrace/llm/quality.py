"""Quality rules: base rules, and likeness to trusted text by hashed n-grams.

Words and pairs of words are hashed into buckets, whose number grows with the
root of the corpus's bytes, as vocabularies do (26,384 for 100 MB, ten million
for 100 TB; the two arrays of counts that are broadcast take 16 bytes each).  The raw
multinomial counts them over all documents, the target multinomial over trusted
documents; both are smoothed by added counts, which grow with the target's mean
count, scaled to the target's total, and leave out the document that is judged.  A document's
score is the mean log-likelihood ratio of its n-grams (with a few neutral ones,
so that short documents need more evidence); it is kept if it fails no base
rule and its score is at least the threshold.  The same table gives the same verdicts.

Trusted documents are those labelled good and not toxic, ``MOST_TRUSTED`` at
most: those with the least hashes of their ids.  Without any, the ratio is 0
and only the base rules count.

Defined results: null and empty texts have no words, so they fail the base
rules; an empty table gives no rows; rows with equal or null ids are judged row
by row (a null id isn't trusted).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import int64s, prepare, tidy
from millrace.llm._text import IS_LEAD, Block, blocks, combine, mix

#: Buckets of the smallest corpus; the root of the corpus's bytes is added.
LEAST_BUCKETS = 1 << 14
#: Bound of the labelled sample that the target multinomial is fitted on.
MOST_TRUSTED = 50_000
#: Counts added to each bucket of both multinomials, so that buckets of little evidence count little:
#: a fixed number, which only a small target feels, and a share of the target's mean count.
FEW, SMOOTHING = 8.0, 0.03
#: Counts in one Arrow batch.
_COUNTS_AT_ONCE = 1 << 16
THRESHOLD = -0.12
#: Neutral n-grams added to each document, so that a short one needs more evidence.
NEUTRAL = 20
MIN_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True


def buckets_for(n_bytes: int) -> int:
    return LEAST_BUCKETS + math.isqrt(n_bytes)


def added(total: float, buckets: int) -> float:
    """Counts added to each bucket where the target has so many n-grams."""
    return FEW + SMOOTHING * total / buckets


def grams(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the block's words and pairs, and the document of each."""
    h, doc = block.word_hashes, block.doc_of()
    pairs = combine(h, 2)
    inside = doc[1:] == doc[:-1]
    return np.concatenate([h, pairs[inside]]) % np.uint64(buckets), np.concatenate([doc, doc[1:][inside]])


def base_rules(block: Block) -> dict[str, np.ndarray]:
    """Base measures of each document of a block whose words are set."""
    n, doc = len(block.counts), block.doc_of()
    data, bounds = block.data, block.bounds
    # lines: spans between line breaks and the documents' bounds
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(bounds, breaks, "right") - 1
    starts = np.concatenate([bounds[:-1], breaks + 1])
    ends = np.concatenate([breaks, bounds[1:]])
    of = np.concatenate([np.arange(n), owner])
    order = np.lexsort((starts, of))
    starts, of = starts[order], of[order]
    end_of = np.concatenate([owner, np.arange(n)])
    ends = ends[np.lexsort((ends, end_of))]
    inside = np.concatenate([[0], np.cumsum(block.inside)])
    worded = inside[ends] > inside[starts]
    starts, ends, of = starts[worded], ends[worded], of[worded]
    lines = mix(block.span_hash(starts, ends) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, firsts = np.unique(lines, return_index=True)
    repeated = np.ones(len(lines), bool)
    repeated[firsts] = False
    dup_lines = np.bincount(of[repeated], minlength=n)
    # words in windows found twice or more
    covered = np.zeros(len(doc) + 1, np.int64)
    if len(doc) >= WINDOW:
        whole = np.flatnonzero(doc[WINDOW - 1 :] == doc[: len(doc) - WINDOW + 1])
        windows = mix(combine(block.word_hashes, WINDOW)[whole] + doc[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(windows)
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(len(windows), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = whole[twice]
        covered[at] += 1
        np.subtract.at(covered, at + WINDOW, 1)
    in_repeat = np.cumsum(covered)[:-1] > 0
    return {
        "n_words": block.counts,
        "word_chars": block.per_doc(block.inside & IS_LEAD[data]),
        "n_symbols": block.per_doc(_IS_SYMBOL[data]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(doc[in_repeat], minlength=n),
    }


def _ready(column: pa.Array) -> Iterator[Block]:
    for block in blocks(column):
        block.words()
        block.word_hashes = block.span_hash(block.starts, block.ends)
        yield block


def is_trusted(column: pa.Array, ids: np.ndarray) -> np.ndarray:
    return np.isin(int64s(column.fill_null(0)), ids) & ~column.is_null().to_numpy(zero_copy_only=False)


def count_grams(docs: DataFrame, trusted: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all n-grams by bucket, over all documents and over the trusted: two counts a bucket."""
    ids = docs.sparkSession.sparkContext.broadcast(trusted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            known = is_trusted(b.column(0), ids.value)
            for block in _ready(b.column(1)):
                bucket, doc = grams(block, buckets)
                bucket = bucket.astype(np.int64)
                raw += np.bincount(bucket, minlength=buckets)
                good = known[block.lo : block.hi]
                if good.any():
                    target += np.bincount(bucket[good[doc]], minlength=buckets)
        seen = np.flatnonzero(raw)
        for lo in range(0, len(seen), _COUNTS_AT_ONCE):
            some = seen[lo : lo + _COUNTS_AT_ONCE]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, raw[some], target[some])], names=["b", "r", "t"])

    found = docs.mapInArrow(tidy(run), "b long, r long, t long").groupBy("b").agg(F.sum("r").alias("r"), F.sum("t").alias("t")).toArrow()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = found["b"].to_numpy()
    raw[at], target[at] = found["r"].to_numpy(), found["t"].to_numpy()
    return raw, target


def scores(block: Block, raw: np.ndarray, target: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Mean log ratio of the target to the raw multinomial over each document's n-grams.

    A document is judged by the counts of the others: its own are left out of
    the raw counts, and of the target's if it is trusted.
    """
    buckets = len(raw)
    bucket, doc = grams(block, buckets)
    n = np.bincount(doc, minlength=len(block.counts))
    total = target.sum()
    if not total:
        return np.zeros(len(n))
    more = added(total, buckets)
    pairs, own = np.unique(doc * buckets + bucket.astype(np.int64), return_counts=True)
    doc, bucket = np.divmod(pairs, buckets)
    expected = (raw[bucket] - own) * (total / raw.sum())
    found = target[bucket] - own * trusted[doc]
    ratios = np.log((found + more) / (expected + more))
    return np.bincount(doc, weights=ratios * own, minlength=len(n)) / (n + NEUTRAL)


def trusted_ids(labels: DataFrame) -> np.ndarray:
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    rows = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_TRUSTED).collect()
    return np.array(sorted(r[0] for r in rows), np.int64)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed, kept, score`` of every document, and the columns to carry."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    trusted = trusted_ids(labels)
    n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counts = docs.sparkSession.sparkContext.broadcast((*count_grams(source, trusted, buckets_for(n_bytes)), trusted))
    carry = carry or []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            measures: dict[str, list] = {m: [] for m in MEASURES}
            raw, target, ids = counts.value
            known, found = is_trusted(b.column(0), ids), []
            for block in _ready(b.column(1)):
                for m, x in base_rules(block).items():
                    measures[m].append(x)
                found.append(scores(block, raw, target, known[block.lo : block.hi]))
            m = {k: np.concatenate(v).astype(np.int64) for k, v in measures.items()}
            score = np.concatenate(found)
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"])
            columns = [b.column(0), *(pa.array(m[k]) for k in MEASURES), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score), *b.columns[2:]]
            names = ["doc_id", *MEASURES, "base_failed", "kept", "score", *(f"carry_{i}" for i in range(len(carry)))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, kept boolean, score double"
    schema += "".join(f", carry_{i} {dict(docs.dtypes)[c]}" for i, c in enumerate(carry))
    found = rows.mapInArrow(tidy(run), schema)
    return found.withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)}) if carry else found
