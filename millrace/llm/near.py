"""Near-duplicates by the exact similarity of shingle sets: SimHash links, and all others of the similarity.

Texts whose sets of shingles have a Jaccard similarity of ``similarity`` or
more are linked, and nothing else is.  Candidates come from two searches.

SimHash: 64-bit fingerprints of the shingle sets, searched within ``TAU`` bits by
``simhash.links`` (generalised pigeonhole).  At a similarity of 0.8 fingerprints
differ in 9.7 bits of 64 on average, with a standard deviation of 2.9, so a
radius that holds such pairs would take thousands of probes a fingerprint; the
SimHash alone therefore finds the closest only.

Bands: texts that share one of ``BANDS`` hashes of ``ROWS`` min-hashes each,
whatever the size of the table: a pair of similarity s is missed with a
probability of (1 - s**ROWS)**BANDS, 7e-5 at 0.8.

Sizes of the sets and a long SimHash, with four standard deviations' allowance,
drop most candidates that are not similar; the others are compared set by set.

A band's group of more than ``SMALL`` gives a spanning forest of its candidates.
Where an exact comparison refutes a link of a forest, the clusters that such
forests connect, and the exact links don't, are searched by differences: each set
is held as its difference from the cluster's hub, the shingles that most of its
sets have.  Sets near the hub are linked with the one that is nearest; others are
similar only if they share differences, and are looked up by the rarest of these.
So a forest costs no link, and sets that lie just below the threshold are not
compared pair by pair.  Of more candidates than ``NEAREST`` a node, the
nearest are compared first, then ``FARTHER`` times as many, and so on; what a link
connects by then is not compared.

Copies (texts of the same set) cost one row.  Of each component one row is kept,
of the least id (nulls last) and then of the least hash of the text.  Null and
empty texts have the empty set; texts of fewer words than a shingle are one
shingle; an empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm._common import durable, int64s, map_arrow, prepare, tidy
from millrace.llm._text import Block, blocks, combine, mix, runs, spread
from millrace.llm.components import stars

#: Bits of the 64-bit fingerprints within which the SimHash's search is complete.
TAU = 3
ROWS, BANDS = 5, 24
#: Groups up to this size give all their candidates.
SMALL = 8
#: Links of a node in a group that are compared together.
TOGETHER = 64
#: Parts in which the links of one fingerprint's texts are compared.
SALTS = 4096
#: Standard deviations by which the SimHashes of similar sets may differ more than they do on average.
ALLOWED = 4
#: Nearest of many candidates that a node is compared with first, and how many times as many in each next round.
NEAREST, FARTHER = 16, 4
_random = np.random.Generator(np.random.PCG64(20240301))
_FLIPS, _TIMES = (_random.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_PLACES = np.array([spread(i) for i in range(ROWS)], np.uint64)
_ROWS_AT_ONCE = 1 << 15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SIDES = ["size", *simhash.CONFIRM]


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By blocks of texts: the block's first row, the sorted hashes of each text's distinct shingles, and how many each has."""
    for block in blocks(column):
        block = Block(_LOWER[block.data], block.bounds, block.lo, block.hi)
        block.words()
        words, counts, first = block.span_hash(block.starts, block.ends), block.counts, block.first[:-1]
        doc = block.doc_of()
        whole = combine(words, n)
        at = np.flatnonzero(doc[n - 1 :] == doc[: len(whole)]) if len(whole) else np.zeros(0, np.int64)
        found, of = whole[at], doc[at]
        for k in range(1, n):  # texts of fewer words are one shingle
            short = np.flatnonzero(counts == k)
            found = np.concatenate([found, combine(words[runs(first[short], counts[short])], k)[::k]])
            of = np.concatenate([of, short])
        order = np.lexsort((found, of))
        found, of = found[order], of[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
        yield block.lo, found[new], np.bincount(of[new], minlength=len(counts))


def bands(found: np.ndarray, firsts: np.ndarray = np.zeros(1, np.int64)) -> np.ndarray:
    """Keys of the bands of each set's min-hashes; ``firsts``: where each set begins, none of them empty."""
    least = np.stack([np.minimum.reduceat((found ^ flip) * times, firsts) for flip, times in zip(_FLIPS, _TIMES, strict=True)], axis=1)
    return mix((least.reshape(-1, BANDS, ROWS) * _PLACES).sum(axis=2, dtype=np.uint64) + _BAND)


def long_simhashes(found: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The longs of each set's SimHash; none of the sets is empty."""
    out = np.zeros((len(firsts), simhash.LONGS), np.uint64)
    counts = np.diff(firsts, append=len(found))
    for k, offset in enumerate(simhash._OFFSETS):
        total = np.zeros((len(firsts), 64), np.int64)
        for lo in range(0, len(found), _ROWS_AT_ONCE):
            part = mix(found[lo : lo + _ROWS_AT_ONCE] + offset)
            some = slice(int(np.searchsorted(firsts, lo, "right")) - 1, int(np.searchsorted(firsts, lo + len(part), "left")))
            total[some] += np.add.reduceat(simhash.bits_of(part), np.maximum(firsts[some] - lo, 0), axis=0, dtype=np.int32)
        out[:, k] = np.packbits(2 * total > counts[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def most_apart(similarity: float) -> int:
    """Bits in which the long SimHashes of sets of the similarity may differ."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(simhash.BITS * p + ALLOWED * math.sqrt(simhash.BITS * p * (1 - p)))


def described(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``doc_id, text_hash, node`` (equal for equal sets), the set's size, long SimHash and bands, of every row."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        n = batch.num_rows
        sizes, nodes, longs, keys = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros((n, simhash.LONGS), np.uint64), np.zeros((n, BANDS), np.uint64)
        for lo, found, counts in shingle_sets(batch.column(2), shingle):
            rows = np.flatnonzero(counts)
            if not len(rows):
                continue
            firsts = (np.cumsum(counts) - counts)[rows]
            rows = rows + lo
            sizes[rows] = counts[counts > 0]
            nodes[rows] = mix(np.add.reduceat(mix(found), firsts) + sizes[rows].astype(np.uint64))
            longs[rows], keys[rows] = long_simhashes(found, firsts), bands(found, firsts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
        return [batch.column(0), batch.column(1), pa.array(nodes.view(np.int64)), pa.array(sizes), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in longs.T), lists]

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return map_arrow(source, run, "doc_id long, text_hash long, node long" + "".join(f", {c} long" for c in SIDES) + ", bands array<long>")


class _Near:
    """Whether members of a group may be similar, by sizes and SimHash."""

    def __init__(self, sizes: np.ndarray, longs: list[np.ndarray], similarity: float):
        self.sizes, self.longs, self.similarity, self.most = sizes, [c.view(np.uint64) for c in longs], similarity, most_apart(similarity)

    def apart(self, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(b), np.int64)
        for c in self.longs:
            out += np.bitwise_count(c[a] ^ c[b])
        return out

    def __call__(self, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        x, y = self.sizes[a], self.sizes[b]
        return (self.apart(a, b) <= self.most) & (np.minimum(x, y) >= self.similarity * np.maximum(x, y))


def _by_key(of_groups: Callable) -> Callable:
    """Applies a function of columns sorted by key to batches, whole groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            new = [int64s(c) for c in b.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
            if cut:
                yield of_groups([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if held is not None and len(held[0]):
            yield of_groups(held)

    return run


LINKS = "key long, u long, v long, salt long, forest boolean"


def _out(found: list[tuple]) -> pa.RecordBatch:
    """Rows of LINKS; the lesser node is ``u``."""
    columns = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 5)]
    key, u, v, salt, forest = columns
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(u), pa.array(v), pa.array(salt), pa.array(forest.astype(bool))], names=["key", "u", "v", "salt", "forest"])


def _candidates(similarity: float) -> Callable:
    """Of rows ``key, node`` and SIDES: all candidates of small groups, and a forest of large ones."""

    def of_groups(columns: list[np.ndarray]) -> pa.RecordBatch:
        keys, nodes, near = columns[0], columns[1], _Near(columns[2], columns[3:], similarity)
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        sizes = np.diff(edges)
        size_of = np.repeat(sizes, sizes)
        found = []
        for k in range(1, min(SMALL, len(keys))):
            a = np.flatnonzero((keys[k:] == keys[:-k]) & (size_of[k:] <= SMALL))
            a = a[near(a, a + k)]
            found.append((keys[a], nodes[a], nodes[a + k], np.zeros(len(a), np.int64), np.zeros(len(a), bool)))
        roles = np.full(len(keys), 3)
        for g in np.flatnonzero(sizes > SMALL).tolist():
            for u, v in zip(*simhash._forest(edges[g], edges[g + 1], nodes, roles, near), strict=True):
                found.append((np.full(len(u), keys[edges[g]]), u, v, np.arange(len(u)) // TOGETHER, np.ones(len(u), bool)))
        return _out(found)

    return _by_key(of_groups)


def differences() -> Callable:
    """Of rows ``node, label, cluster, members``, SIDES, ``shared`` and ``hub``: the shingles in which a set differs from its cluster's hub.

    ``shared`` has the set's shingles that others of the cluster have too, and how
    many have each, and ``hub`` those that most have.  Shingles of the set alone
    stand before all others; a first row of the place -1 names the cluster.
    """

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        rows_of = np.arange(batch.num_rows)
        clusters, members, sizes = (int64s(batch.column(k)) for k in (2, 3, 4))
        lists = [batch.column(batch.num_columns - k) for k in (2, 1)]
        counts = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
        (own_n, own), (hub_n, hub) = ([int64s(x.flatten().field(k)) for k in ("n", "token")] for x in lists)
        row, hub_row = (np.repeat(rows_of, c) for c in counts)
        common = 2 * own_n > members[row]
        # of the hub's shingles those are missing that the set's own don't have: twice there after a sort, they fall out
        token, of, n = np.concatenate([own[common], hub]), np.concatenate([row[common], hub_row]), np.concatenate([np.zeros(common.sum(), np.int64), (members[hub_row] - hub_n)])
        order = np.lexsort((n, token, of))
        token, of, n = token[order], of[order], n[order]
        same = np.zeros(len(token) + 1, bool)
        same[1:-1] = (token[1:] == token[:-1]) & (of[1:] == of[:-1])
        missing = ~(same[1:] | same[:-1])
        token, of, n = np.concatenate([own[~common], token[missing]]), np.concatenate([row[~common], of[missing]]), np.concatenate([own_n[~common], n[missing]])
        order = np.lexsort((token, n, of))
        token, of = token[order], of[order]
        listed = np.bincount(of, minlength=batch.num_rows)
        alone = sizes - counts[0]
        places = alone[of] + runs(np.zeros(len(listed), np.int64), listed)
        salt = mix(clusters.view(np.uint64))
        keys = np.concatenate([salt, mix(token.view(np.uint64) + salt[of])]).view(np.int64)
        of = np.concatenate([rows_of, of])
        take = pa.array(of)
        return [pa.array(keys), pa.array(np.concatenate([np.full(batch.num_rows, -1), places])), pa.array((alone + listed)[of]), *(batch.column(k).take(take) for k in (0, 1, *range(4, batch.num_columns - 2)))]

    return run


MEETINGS = "u long, v long, apart long"


def _meetings(similarity: float) -> Callable:
    """Of rows ``key, place, differ, node, label`` and SIDES: candidates that meet at a difference and that no link connects.

    Sets that differ from a hub by a and b shingles differ by a + b at most.  If
    the similarity allows that, both are similar to the set that differs least
    for its size, and are compared with it; if not, they have as many differences
    in common as it takes, and the first of them has enough behind it.
    """

    def of_groups(columns: list[np.ndarray]) -> pa.RecordBatch:
        keys, places, differ, nodes, labels, sizes = columns[:6]
        near = _Near(sizes, columns[6:], similarity)
        over = differ - (1 - similarity) / (1 + similarity) * sizes  # two similar sets differ by less than the sum of what is subtracted
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        found = []

        def add(i: int, others: np.ndarray) -> None:
            others = others[near(i, others)]
            found.append((np.minimum(nodes[i], nodes[others]), np.maximum(nodes[i], nodes[others]), near.apart(i, others)))

        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own, counts = np.unique(labels[lo:hi], return_counts=True)
            if len(own) == 1:
                continue
            every = np.arange(lo, hi)
            if places[lo:hi].min() < 0:
                firsts = every[places[lo:hi] < 0]
                i = int(firsts[np.lexsort((nodes[firsts], over[firsts]))[0]])
                add(i, firsts[(over[firsts] + over[i] <= 1e-6) & (labels[firsts] != labels[i])])
                every = every[places[lo:hi] >= 0]
            rest = differ[every] - places[every]
            for i in every[labels[every] != own[counts.argmax()]].tolist():  # a pair of two labels has one of these
                sums = over[every] + over[i]
                enough = np.minimum(differ[i] - places[i], rest) >= np.ceil(sums / 2 - 1e-6)
                add(i, every[enough & (sums > -1e-6) & (labels[every] != labels[i])])
        columns = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 3)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["u", "v", "apart"])

    return _by_key(of_groups)


def meetings(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``u, v, apart``: candidates with different labels that connect all similar sets of a cluster; of ``node, label, cluster`` and SIDES."""

    def tokens_of(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(3)]
        take = pa.array(np.repeat(np.arange(len(found)), list(map(len, found))))
        return [pa.array(np.concatenate(found)), *(batch.column(k).take(take) for k in range(3))]

    members = durable(members.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("cluster"))), "members")
    tokens = map_arrow(members.select("node", "cluster", "members").join(sets, "node").select("node", "cluster", "members", "found"), tokens_of, "token long, node long, cluster long, members long", 1000)
    shared = durable(tokens.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cluster", "token"))).where("n > 1"), "shared")
    hubs = shared.where("2 * n > members").groupBy("cluster", "token").agg(F.min("n").alias("n")).groupBy("cluster").agg(F.collect_list(F.struct("n", "token")).alias("hub"))
    own = shared.groupBy("node").agg(F.collect_list(F.struct("n", "token")).alias("shared"))
    described = members.join(own, "node").join(hubs, "cluster", "left")
    described = described.select("node", "label", "cluster", "members", *SIDES, "shared", F.coalesce("hub", F.array().cast("array<struct<n:bigint,token:bigint>>")).alias("hub"))
    schema = "key long, place long, differ long, node long, label long" + "".join(f", {c} long" for c in SIDES)
    first = map_arrow(described, differences(), schema)
    found = first.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_meetings(similarity)), MEETINGS)
    return durable(found.groupBy("u", "v").agg(F.min("apart").alias("apart")), "meetings")


def sets_of(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``node, found``: the nodes' sets; ``texts`` has ``node, text``."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        sets: list[bytes] = []
        for _, found, counts in shingle_sets(batch.column(1), shingle):
            ends = np.cumsum(counts)
            sets += [found[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
        return [batch.column(0), pa.array(sets, pa.binary())]

    return durable(map_arrow(texts.join(nodes, "node", "left_semi").select("node", "text"), run, "node long, found binary"), "sets")


def compared(pairs: DataFrame, sets: DataFrame, similarity: float, name: str) -> DataFrame:
    """``u, v, similar`` of pairs ``u, v, salt`` by their sets."""

    def compare(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = sorted((np.frombuffer(s.as_py(), np.uint64) for s in (a, b)), key=len)
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
            out.append(both >= similarity * (len(x) + len(y) - both))
        return [batch.column(0), batch.column(1), pa.array(out, pa.bool_())]

    left = pairs.select("u", "salt").distinct().join(sets.select(F.col("node").alias("u"), F.col("found").alias("a")), "u")
    right = pairs.join(sets.select(F.col("node").alias("v"), F.col("found").alias("b")), "v")
    return durable(map_arrow(right.join(left, ["u", "salt"]).select("u", "v", "a", "b"), compare, "u long, v long, similar boolean"), name)


def simhash_candidates(classes: DataFrame) -> DataFrame:
    """``u, v, salt``: links between nodes within ``TAU`` bits of each other, of which one node stands for each fingerprint."""
    prints = durable(classes.groupBy(F.col("c0").alias("fp")).agg(F.min("node").alias("rep")), "prints")
    found = simhash.links(prints.select("fp", F.col("fp").alias("node")), TAU)
    name = lambda c, to: prints.select(F.col("fp").alias(c), F.col("rep").alias(to))
    between = found.join(name("u", "a"), "u").join(name("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    same = classes.select(F.col("c0").alias("fp"), "node").join(prints, "fp").where("node <> rep").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    return between.union(same).select("u", "v", F.pmod(F.xxhash64("v"), F.lit(SALTS)).alias("salt"))


def links(classes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``u, v``: links that connect all candidates of the similarity, each of them compared exactly."""
    rows = classes.select(F.explode("bands").alias("key"), "node", *SIDES)
    dealt = rows.repartition("key").sortWithinPartitions("key")
    first = durable(dealt.mapInArrow(tidy(_candidates(similarity)), LINKS), "candidates")
    found = first.select("u", "v", "salt").union(simhash_candidates(classes))
    pairs = durable(found.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("salt").alias("salt")), "pairs")
    sets = sets_of(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), texts, shingle)
    seen = compared(pairs, sets, similarity, "compared")
    in_forest = first.where("forest").select("key", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    again = durable(in_forest.join(seen.where("not similar"), ["u", "v"]).select("key").distinct(), "again")
    if again.isEmpty():
        return seen.where("similar").select("u", "v")
    labelled = lambda: stars(seen.where("similar").select("u", "v"), "exact-stars").select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = labelled()
    these = in_forest.join(again, "key", "left_semi")
    clusters = stars(these.select("u", "v"), "clusters").select(F.col("u").alias("node"), F.col("v").alias("cluster"))
    ends = these.select(F.col("u").alias("node")).union(these.select("v")).distinct().join(labels, "node", "left").join(clusters, "node", "left")
    ends = durable(ends.select("node", F.coalesce("label", "node").alias("label"), F.coalesce("cluster", "node").alias("cluster")), "ends")
    parted = ends.groupBy("cluster").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("cluster")
    nodes = durable(ends.join(parted, "cluster", "left_semi").select("node", "label", "cluster"), "parted")
    members = nodes.join(classes.select("node", *SIDES), "node").select("node", "label", "cluster", *SIDES)
    left = meetings(members, sets, similarity).join(seen, ["u", "v"], "left_anti")
    nearest, end = Window.partitionBy("u").orderBy("apart", "v"), NEAREST
    left = durable(left.withColumn("place", F.row_number().over(nearest) - 1).withColumn("salt", F.floor(F.col("place") / TOGETHER)), "left")
    few = NEAREST * nodes.count()
    while not left.isEmpty():
        at_once = left.count() <= few
        seen = seen.union(compared((left if at_once else left.where(F.col("place") < end)).select("u", "v", "salt"), sets, similarity, "compared"))
        if at_once:
            break
        labels = labelled()
        root = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        left = left.where(F.col("place") >= end).join(root("u"), "u", "left").join(root("v"), "v", "left")
        left = durable(left.where(F.coalesce("u_label", "u") != F.coalesce("v_label", "v")).select("u", "v", "apart", "place", "salt"), "left")
        end *= FARTHER
    return seen.where("similar").select("u", "v")


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, text_hash, component``: the row that is kept of each component."""
    prepare(docs.sparkSession)
    prints = durable(described(docs, id_col, text_col, shingle), "described")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("best")
    classes = durable(prints.groupBy("node").agg(best, *(F.first(c).alias(c) for c in [*SIDES, "bands"])), "classes")
    # copies of a text fall together before they are joined
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).groupBy("text_hash").agg(F.first("text").alias("text"))
    texts = texts.join(classes.select(F.col("best.text_hash").alias("text_hash"), "node"), "text_hash").select("node", "text")
    found = stars(links(classes, texts, shingle, similarity), "near-stars").select(F.col("u").alias("node"), F.col("v").alias("root"))
    rooted = classes.select("node", "best").join(found, "node", "left").select(F.coalesce("root", "node").alias("component"), "best")
    return rooted.groupBy("component").agg(F.min("best").alias("best")).select("best.doc_id", "best.text_hash", "component")
