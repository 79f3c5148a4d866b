"""Token-ID output: raw id payloads with a minimal perfect hash index for keyed access.

A store is a folder of shards in ascending key order.  ``shard-N.bin`` holds
nothing but the ids of its documents, little-endian, two bytes each if the
vocabulary allows and four otherwise.  ``shard-N.idx`` is the index: bit arrays
of a minimal perfect hash over the shard's keys and, at each key's slot, a
32-bit fingerprint of the key, the offset and number of its ids, and how many
documents have the key.  ``manifest.json`` lists the shards' key ranges and
totals.  A lookup finds the shard by its range, the slot by a few bit probes,
and reads one slice; a key that isn't stored fails the fingerprint, but for one
in 2**32.

Defined results: a null text is empty (its record is the end id); documents
with equal keys are kept one after another, numbered from 0; a null key sorts
first and is a key of its own; an empty table gives a store without shards.
Tasks write under a temporary name and rename, so a lost or repeated task
leaves whole shards only.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import int64s, prepare, rows_below, tidy
from millrace.llm._text import mix
from millrace.llm._tokens import Encoder

#: Bits of each level of the hash for one key still to be placed.
GAMMA = 2
#: Ids read from a payload at once.
WINDOW = 1 << 20
#: Hash functions tried until no two keys of a shard have one hash.
SEEDS = 16


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all executors reach (file on a shared mount, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def key_hash(keys: np.ndarray, nulls: np.ndarray, numbers: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of keys with their number among equal keys."""
    x = mix(keys.astype(np.int64).view(np.uint64) + np.uint64((0x632BE59BD9B4E019 + seed * 0x9FB21C651E98DF25) % 2**64))
    x = np.where(nulls, np.uint64(0x8CB92BA72F3D8DD7), x)
    return mix(x + numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class PerfectHash:
    """A minimal perfect hash: level by level, keys alone at their place set a bit there; the others go on."""

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes
        counts = [np.bitwise_count(x).astype(np.int64) for x in levels]
        self.ranks = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
        self.bases = np.concatenate([[0], np.cumsum([r[-1] for r in self.ranks])]).astype(np.int64)

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes + np.uint64((level + 1) * 0xA24BAED4963EE407 & (2**64 - 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, levels, sizes = np.unique(hashes), [], []
        if len(left) != len(hashes):
            raise ValueError("two keys have one 64-bit hash")
        while len(left):
            size = -(-GAMMA * len(left) // 64) * 64
            at = cls._place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(levels, sizes)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 where it is known not to be a key."""
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        for level, (bits, size) in enumerate(zip(self.levels, self.sizes, strict=True)):
            at = self._place(hashes[todo], level, size)
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            here = (bits[word] >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
            out[todo[here]] = (self.bases[level] + self.ranks[level][word] + below)[here]
            todo = todo[~here]
            if not len(todo):
                break
        return out


class Index:
    """The index of a shard: the perfect hash and what stands at its slots."""

    FIELDS = ("fingerprint", "<u4"), ("offset", "<u8"), ("length", "<u4"), ("same", "<u4")

    def __init__(self, mph: PerfectHash, fields: dict[str, np.ndarray], seed: int):
        self.mph, self.fields, self.seed = mph, fields, seed

    @classmethod
    def build(cls, keys: np.ndarray, nulls: np.ndarray, numbers: np.ndarray, lengths: np.ndarray, same: np.ndarray) -> Index:
        for seed in range(SEEDS):
            hashes = key_hash(keys, nulls, numbers, seed)
            if len(np.unique(hashes)) == len(hashes):
                break
        mph = PerfectHash.build(hashes)
        slots = mph.slots(hashes)
        values = {"fingerprint": hashes & np.uint64(0xFFFFFFFF), "offset": np.cumsum(lengths) - lengths, "length": lengths, "same": same}
        fields = {}
        for name, kind in cls.FIELDS:
            fields[name] = np.zeros(len(hashes), kind)
            fields[name][slots] = values[name]
        return cls(mph, fields, seed)

    def find(self, keys: np.ndarray, nulls: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is there, and its offset, length and number of equal keys."""
        hashes = key_hash(keys, nulls, numbers, self.seed)
        slots = self.mph.slots(hashes)
        found = slots >= 0
        at = np.where(found, slots, 0)
        if not len(self.fields["fingerprint"]):
            return found, at, at, at
        found &= self.fields["fingerprint"][at] == (hashes & np.uint64(0xFFFFFFFF))
        return found, *(self.fields[n][at].astype(np.int64) for n in ("offset", "length", "same"))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, seed=np.int64(self.seed), sizes=np.array(self.mph.sizes, np.int64), **{f"level{i}": x for i, x in enumerate(self.mph.levels)}, **self.fields)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Index:
        with np.load(io.BytesIO(data)) as z:
            sizes = z["sizes"].tolist()
            return cls(PerfectHash([z[f"level{i}"] for i in range(len(sizes))], sizes), {n: z[n] for n, _ in cls.FIELDS}, int(z["seed"]))


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _writer(uri: str, tokenizer_path: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path)
        fs, base = filesystem(uri)
        shard = TaskContext.get().partitionId()
        temporary = f"{base}/_temporary-{shard}-{uuid.uuid4().hex}"
        keys, nulls, lengths, out = [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or fs.open_output_stream(f"{temporary}.bin")
            texts = batch.column(1).fill_null("")
            for lo, hi in rows_below(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), WINDOW):
                ids, bounds = encoder.encode_column(texts.slice(lo, hi - lo))
                out.write(np.insert(ids, bounds[1:], end_id).astype(kind).tobytes())
                lengths.append(np.diff(bounds) + 1)
            keys.append(int64s(batch.column(0).fill_null(0)))
            nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        k, z, n = np.concatenate(keys), np.concatenate(nulls), np.concatenate(lengths)
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (z[1:] != z[:-1])
        group = np.cumsum(new) - 1
        number = np.arange(len(k)) - np.flatnonzero(new)[group]
        index = Index.build(k, z, number, n, np.bincount(group)[group])
        with fs.open_output_stream(f"{temporary}.idx") as f:
            f.write(index.to_bytes())
        for ext in ("bin", "idx"):
            final = f"{base}/shard-{shard}.{ext}"
            if fs.get_file_info(final).type != pafs.FileType.NotFound:
                fs.delete_file(final)
            fs.move(f"{temporary}.{ext}", final)
        row = {"shard": shard, "docs": len(k), "ids": int(n.sum()), "first": int(k[0]), "last": int(k[-1]), "null_first": bool(z[0]), "null_last": bool(z[-1])}
        yield pa.RecordBatch.from_pylist([row])

    return run


def write_store(docs: DataFrame, uri: str, tokenizer_path: str, end_id: int, shards: int, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode every document, append ``end_id``, write the store; returns (and writes) its manifest.

    Only the manifest's rows, one for each shard, reach the driver.
    """
    prepare(docs.sparkSession)
    fs, base = filesystem(uri)
    fs.create_dir(base, recursive=True)
    kind = id_type(max(Encoder.of(tokenizer_path).size, end_id + 1))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = source.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = "shard long, docs long, ids long, first long, last long, null_first boolean, null_last boolean"
    rows = sorted((r.asDict() for r in ordered.mapInArrow(tidy(_writer(uri, tokenizer_path, end_id, kind)), schema).collect()), key=lambda r: r["shard"])
    start = 0
    for r in rows:
        r["start"] = start
        start += r["ids"]
    manifest = {"version": 1, "ids": kind, "shards": rows}
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(uri: str) -> dict:
    fs, base = filesystem(uri)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        return json.loads(f.read())


class Payload:
    """Slices of a shard's ids, read through a moving window."""

    def __init__(self, fs: pafs.FileSystem, path: str, kind: str):
        self.file, self.kind, self.width = fs.open_input_file(path), kind, np.dtype(kind).itemsize
        self.at, self.held = 0, b""

    def ids(self, offset: int, length: int) -> np.ndarray:
        lo, size = offset * self.width, length * self.width
        if lo < self.at or lo + size > self.at + len(self.held):
            self.at, self.held = lo, self.file.read_at(max(size, WINDOW * self.width), lo)
        return np.frombuffer(self.held, self.kind, length, lo - self.at)


def _shard_of(manifest: dict):
    shards = [s for s in manifest["shards"] if not s["null_last"]]  # that hold other keys than null
    lasts = np.array([s["last"] for s in shards], np.int64)
    numbers = np.array([s["shard"] for s in shards] + [-1], np.int64)
    of_null = next((s["shard"] for s in manifest["shards"] if s["null_first"]), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = numbers[np.searchsorted(lasts, int64s(b.column(0).fill_null(0)), "left")]
            nulls = b.column(0).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(nulls, of_null, at))], names=["doc_id", "shard"])

    return run


def _reader(uri: str, manifest: dict, out_names: list[str]):
    starts = {s["shard"]: s["start"] for s in manifest["shards"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(uri)
        held, index, payload = None, None, None
        for batch in batches:
            shards, rows = batch.column(1).to_numpy(), {n: [] for n in out_names}
            keys, nulls = int64s(batch.column(0).fill_null(0)), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(shards, prepend=shards[0] - 1)).tolist() + [len(shards)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                shard = int(shards[lo])
                if shard < 0:
                    continue
                if held != shard:
                    with fs.open_input_stream(f"{base}/shard-{shard}.idx") as f:
                        index = Index.from_bytes(f.read())
                    held, payload = shard, Payload(fs, f"{base}/shard-{shard}.bin", manifest["ids"])
                found, _, _, same = index.find(keys[lo:hi], nulls[lo:hi], np.zeros(hi - lo, np.int64))
                times = np.where(found, same, 0)
                which = np.repeat(np.arange(lo, hi), times)
                number = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                _, offsets, lengths, _ = index.find(keys[which], nulls[which], number)
                for i, offset, length in sorted(zip(which.tolist(), offsets.tolist(), lengths.tolist(), strict=True), key=lambda x: x[1]):
                    ids = payload.ids(offset, length).astype("<u4")
                    rows["doc_id"].append(None if nulls[i] else int(keys[i]))
                    rows["start"].append(starts[shard] + offset)
                    rows["n_tokens"].append(length)
                    rows["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                    if "ids" in rows:
                        rows["ids"].append(ids.astype(np.int64).tolist())
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(n, pa.list_(pa.int64()) if n == "ids" else pa.int64()) for n in out_names]))

    return run


def read_keys(spark: SparkSession, uri: str, keys: DataFrame, key_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The records of the given keys: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``); unknown keys have none.

    ``start`` counts the ids of all documents before it in the whole store.
    """
    prepare(spark)
    manifest = read_manifest(uri)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = ", ".join(f"{n} {'array<long>' if n == 'ids' else 'long'}" for n in names)
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)
    distinct = keys.select(F.col(key_col).cast("long").alias("doc_id")).distinct()
    placed = distinct.mapInArrow(tidy(_shard_of(manifest)), "doc_id long, shard long").repartition(len(manifest["shards"]), "shard").sortWithinPartitions("shard", "doc_id")
    return placed.mapInArrow(tidy(_reader(uri, manifest, names)), schema)
