"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here; its normaliser, white-space marker, pieces,
scores and byte fallback are rebuilt as a tokenizers ``Tokenizer``: a unigram
model from the scores, or a BPE whose merges are ranked by the scores of what
they make.  Texts are encoded in batches on the library's threads, and the
parity with the sentencepiece library is verified on probes when a model is
loaded and, while encoding, on all that the rebuilt model encodes: on every text
that is encoded whole, and on every distinct piece of the others when a worker
first meets it (a difference is an error, and so is a worker without that
library).

Where no piece of the model has a marker after another character, a text may be
cut before its runs of spaces and around line breaks, and pieces keep their ids;
this holds for identity normalisers only, and other texts are encoded whole.
Both libraries encode such pieces as they do in the text, so ids verified piece
by piece are the text's (tests hold whole texts against the library).

Defined results: null and empty texts have no ids; rows with null or equal ids
are encoded row by row; an empty table gives no rows.  Decoding inverts
encoding for identity normalisers, but for texts with the marker character
itself, which comes back as a space.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from millrace.llm._common import map_arrow, prepare
from millrace.llm._tokens import Pieces, holding, joined, vocabulary

MARK = "▁"
#: Threads of a worker for encoding batches.
THREADS = 2
#: Kinds of pieces in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
PROBES = ["", " ", "a", "Hello world", "  two  spaces ", "line\nbreak\ttab", "naïve café – “quotes”", "数学 и русский", "😀 emoji", "x" * 300, "1234567890", "don't  stop...", "a　b c", "́e", "ﬁ Ⅷ ½"]


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def protobuf_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and raw values of a message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} is not known")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    suffix_marker: bool = False

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in protobuf_fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in protobuf_fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        (score,) = struct.unpack("<f", v)
                    elif n == 3:
                        kind = v
                m.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in protobuf_fields(value):
                    if n == 3:
                        m.kind = v
                    elif n == 24:
                        m.suffix_marker = bool(v)
                    elif n == 35:
                        m.byte_fallback = bool(v)
            elif number == 3:
                for n, v in protobuf_fields(value):
                    if n == 2:
                        m.charsmap = v
                    elif n in (3, 4, 5):
                        setattr(m, {3: "dummy_prefix", 4: "remove_extra", 5: "escape"}[n], bool(v))
        if m.kind not in (UNIGRAM, BPE):
            raise ValueError(f"models of kind {m.kind} are not supported")
        if m.suffix_marker or not m.escape:
            raise ValueError("white space as a suffix, or unescaped, is not supported")
        return m

    @property
    def unknown(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)


def ranked_merges(model: Model) -> list[tuple[str, str]]:
    """Every split of every piece into two pieces, best score of the whole first."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, i in ids.items():
        splits = [(ids[piece[:c]], ids[piece[c:]]) for c in range(1, len(piece)) if piece[:c] in ids and piece[c:] in ids]
        found += [(-model.pieces[i][1], i, *s) for s in sorted(splits)]
    found.sort(key=lambda x: x[:2])
    return [(model.pieces[a][0], model.pieces[b][0]) for _, _, a, b in found]


def build_tokenizer(model: Model) -> Tokenizer:
    """The tokenizers pipeline of a model; the dummy prefix is added by ``Codec``."""
    unknown = model.unknown
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, ranked_merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Replace(Regex(" {2,}"), " ")]
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    user = [p for p, _, kind in model.pieces if kind == USER_DEFINED]
    if user:
        tokenizer.add_tokens(user)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer


class Codec(Pieces):
    """Encodes and decodes with a SentencePiece model."""

    _known: dict[str, Codec] = {}

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        with open(path, "rb") as f:
            self.model = Model.parse(f.read())
        m = self.model
        texts = [p for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED)]
        cuts = not m.charsmap and not m.remove_extra and m.kind == BPE and not any(MARK in p.lstrip(MARK) for p in texts) and not any(k == USER_DEFINED for _, _, k in m.pieces)
        self.lines = not any("\n" in p for p in texts)  # then nothing merges across a line break
        tokenizer = build_tokenizer(m)
        super().__init__(tokenizer, cuts and self.lines)
        self.opens = np.array([t.startswith(MARK) for t in vocabulary(tokenizer)])  # ids that begin with a space
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in m.pieces]
        self.size = len(m.pieces)
        self.reference = None
        try:
            import sentencepiece
        except ModuleNotFoundError:
            return
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        #: What the library writes before a text that follows a line break.
        self.line = self.reference.encode("\n")
        for text, ids in zip(PROBES, self.encode_texts(PROBES), strict=True):
            self.verify(text, ids)

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def uncut(self, data: bytes, bounds: np.ndarray) -> set[int]:
        return holding([MARK.encode()], data, bounds)

    def begins(self, data: np.ndarray) -> np.ndarray:
        out, space, line = np.ones(len(data), bool), data == 0x20, data == 0x0A
        out[1:] = space[1:] & ~space[:-1] | line[1:] | line[:-1]
        return out

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids that the rebuilt model gives to texts, verified."""
        ids, counts = super().whole(texts)
        if texts:
            self._same(texts, ids, counts)
        return ids, counts

    def learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        def groups_of(groups: list[list[bytes]]) -> list[list[int]]:
            return [e.ids for e in self.tokenizer.encode_batch_fast([b"".join(g).decode() for g in groups], add_special_tokens=False)]

        def parts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            starts = np.flatnonzero(self.opens[ids])
            return ids, np.diff(starts, append=len(ids)) if len(starts) and starts[0] == 0 else starts[:0]

        ids, counts = self.learn_joined(new, [p[:1] == b" " and p[1:2] not in (b"", b" ") for p in new], groups_of, parts)
        self._same([p.decode() for p in new], ids, counts)
        return ids, counts

    def _same(self, texts: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Raises if the sentencepiece library encodes a text otherwise, where it stands without the dummy prefix."""
        if self.reference is None:
            raise ModuleNotFoundError("the sentencepiece library is needed to verify texts")
        # the library itself puts a space first, unless a line break stands there
        first = [self.model.dummy_prefix and t[:1] == " " and len(t) > 1 for t in texts]
        asked = [t[1:] if f else "\n" + t if self.model.dummy_prefix else t for t, f in zip(texts, first, strict=True)]
        found, n = joined([r if f or not self.model.dummy_prefix else r[len(self.line) :] for r, f in zip(self.reference.encode(asked), first, strict=True)])
        if not (np.array_equal(counts, n) and np.array_equal(ids, found)):
            at = np.cumsum(counts) - counts
            wrong = next((t for t, a, c, r in zip(texts, at, counts, np.split(found, np.cumsum(n)[:-1]), strict=True) if not np.array_equal(ids[a : a + c], r)), "")
            raise ValueError(f"parity with sentencepiece fails: {wrong[:80]!r}")

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, four bytes an id."""
        if self.model.remove_extra:
            texts = [t.strip(" ") for t in texts]
        if self.model.dummy_prefix:
            texts = [" " + t if t else t for t in texts]
        return self.encode(texts)

    def decode(self, ids: list[int]) -> str:
        text = self.tokenizer.decode(ids, skip_special_tokens=False)
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def decode_ids(self, ids: np.ndarray) -> bytes:
        """Bytes of the text that valid ids stand for: what ``decode`` gives, for ids of whole characters."""
        out = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return out[1:] if self.model.dummy_prefix and out.startswith(b" ") else out

    def verify(self, text: str, data: bytes) -> None:
        """Raises if the sentencepiece library encodes the text otherwise, or the decoders differ."""
        if self.reference is None:
            raise ModuleNotFoundError("the sentencepiece library is needed to verify texts")
        ids = np.frombuffer(data, "<u4")
        if self.reference.encode(text) != ids.tolist():
            raise ValueError(f"parity with sentencepiece fails: {text[:80]!r}")
        if self.model.unknown not in ids and self.decode(ids.tolist()).encode() != self.decode_ids(ids):
            raise ValueError(f"decoders differ: {text[:80]!r}")


SCHEMA = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, verified boolean"


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Ids of every whole text, decoded again: counts, checksums, and the ids themselves if asked for.

    ``verified`` tells that the text, or each of its pieces, was held against
    the sentencepiece library; all are.
    """
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = Codec.of(model_path)
        if codec.reference is None:
            raise ModuleNotFoundError("the sentencepiece library is needed to verify texts")
        texts = batch.column(1).fill_null("").to_pylist()
        rows: list[tuple] = []
        encoded = codec.encode_texts(texts)
        for data in encoded:
            back = codec.decode_ids(np.frombuffer(data, "<u4"))
            rows.append((len(data) // 4, zlib.crc32(data), hashlib.sha256(back).hexdigest(), True))
        n, crc, sha, verified = zip(*rows, strict=True)
        out = [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(verified)]
        if with_ids:
            out.append(pa.array([np.frombuffer(x, "<u4").tolist() for x in encoded], pa.list_(pa.int64())))
        return out

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(source, run, SCHEMA + ", ids array<long>" * with_ids)


def decode_documents(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from rows with ids; null ids give a null text."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = Codec.of(model_path)
        return [batch.column(0), pa.array([None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()], pa.string())]

    prepare(encoded.sparkSession)
    return map_arrow(encoded.select("doc_id", F.col(ids_col).cast("array<long>").alias("ids")), run, "doc_id long, text string")
