import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import packing, sentencepiece_codec, token_store
from millrace.llm._tokens import Encoder
from millrace.llm.queries import tokenizer_file

from .conftest import TEXTS

BPE = tokenizer_file("byte_bpe_50k.json")
SPM = tokenizer_file("piece_bpe_32k.model")


def plain(text):
    return Encoder.of(BPE).tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aB'é, .\n\t 1- \x1c中!sdt<|", max_size=30), max_size=4))
def test_pieces_give_the_ids_of_whole_texts(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder.of(BPE).encode(texts)] == [plain(t) for t in texts]


def test_random_texts_of_many_kinds_of_characters():
    rng = random.Random(7)
    parts = [*"ab z0 \n,.'é\t\x1c\x00\x01\x7fжΩ中あ—’🙂º١Ⅷ\u0301\u0085\xa0\u3000\u2003", "'s", "'re", "'LL", "  ", "<|endoftext|>", "abc", "Hello", "12", " x", "\r\n", "long" * 9, "é" * 13]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder.of(BPE).encode(texts)] == [plain(t) for t in texts]


def test_a_text_of_megabytes():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 30))) for _ in range(20000)]
    text = " ".join(rng.choice(words) for _ in range(330_000))
    assert len(text) > 5_000_000
    assert np.array_equal(np.frombuffer(Encoder(BPE).encode([text, "b"])[0], "<u4"), plain(text))


def test_pieces_survive_a_full_store(monkeypatch):
    import millrace.llm._tokens as m

    monkeypatch.setattr(m, "KEPT_PIECES", 5)
    monkeypatch.setattr(m, "GROUP_BYTES", 20)
    texts = [t or "" for t in TEXTS] * 2
    encoder = m.Encoder(BPE)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [plain(t) for t in texts]


def test_other_tokenizers_encode_whole_texts():
    encoder = Encoder.of(tokenizer_file("word_bpe_49k.json"))
    assert not encoder.cuts
    assert np.frombuffer(encoder.encode(["Hello there"])[0], "<u4").tolist() == encoder.tokenizer.encode("Hello there", add_special_tokens=False).ids


# packing


def check_packing(rows, docs, max_len, end_id=0):
    want = []
    for d, t in docs:
        ids = plain(t) + [end_id]
        first = (len(ids) - 1) % max_len + 1
        cuts = [0, *range(first, len(ids) + 1, max_len)]
        want += [(d, i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_len
    return len(sequences), sum(r.length for r in rows)


def test_packing_of_awkward_texts(awkward):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    check_packing(packing.pack(awkward, BPE, max_len=64).collect(), docs, 64)


def test_packing_is_close_to_one_best_fit_of_all(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_TASK", 40)
    rng = random.Random(3)
    docs = [(i, " a" * rng.choice([3, 40, 90, 130, 200, 260, 900])) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(12)
    rows = packing.pack(df, BPE, max_len=256).collect()
    n, _ = check_packing(rows, docs, 256)
    bins, _ = packing.best_fit(np.array([r.length for r in rows], np.int64), 256)
    assert n <= 1.02 * (bins.max() + 1)


def test_packing_of_items_that_never_share(spark):
    docs = [(i, " a" * 150) for i in range(300)]
    n, _ = check_packing(packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), BPE, max_len=256).collect(), docs, 256)
    assert n == 300


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, BPE).count() == 0


@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_bins_hold(sizes):
    bins, offsets = packing.best_fit(np.array(sizes, np.int64), 50)
    fill = {}
    for b, o, s in sorted(zip(bins.tolist(), offsets.tolist(), sizes, strict=True)):
        assert o == fill.get(b, 0)
        fill[b] = o + s
    assert all(f <= 50 for f in fill.values())
    assert sum(f <= 25 for f in fill.values()) <= 1


# token store


def test_store_reads_back_every_document(spark, awkward, tmp_path):
    docs = sorted(((r.doc_id, r.text) for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    uri = f"file://{tmp_path}/store"
    manifest = token_store.write_store(awkward, uri, BPE, end_id=2, shards=3)
    assert json.loads((tmp_path / "store/manifest.json").read_text()) == manifest
    got = token_store.read_keys(spark, uri, awkward, with_ids=True).collect()
    assert sorted((str(r.doc_id), tuple(r.ids), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), (*plain(t), 2), len(plain(t)) + 1, crc([*plain(t), 2])) for d, t in docs)
    at = 0
    for r in sorted(got, key=lambda r: r.start):  # gapless, in the order of ids
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [d for d, _ in docs]
    unknown = spark.createDataFrame([(10**9,), (-5,)], "doc_id long")
    assert token_store.read_keys(spark, uri, unknown).count() == 0


def test_store_of_nothing(spark, nothing, tmp_path):
    token_store.write_store(nothing, f"file://{tmp_path}/s", BPE, 2, 4)
    assert token_store.read_keys(spark, f"file://{tmp_path}/s", nothing).count() == 0


@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
def test_perfect_hash_is_minimal(keys):
    hashes = np.array(sorted(keys), np.uint64)
    mph = token_store.PerfectHash.build(hashes)
    assert sorted(mph.slots(hashes).tolist()) == list(range(len(hashes)))


def test_index_round_trip_and_unknown_keys(monkeypatch):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, 5000))
    none, zero = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    lengths = rng.integers(1, 9, len(keys))
    build = lambda: token_store.Index.build(keys, none, zero, lengths, np.ones(len(keys), np.int64))
    plain_hash = token_store.key_hash
    for first_seed in (0, 2):  # hashes that meet are tried with another seed
        monkeypatch.setattr(token_store, "key_hash", lambda k, z, n, seed=0, least=first_seed: plain_hash(k, z, n, seed) * np.uint64(seed >= least))
        index = token_store.Index.from_bytes(build().to_bytes())
        assert index.seed == first_seed
        found, offset, length, _ = index.find(keys, none, zero)
        assert found.all() and (length == lengths).all() and (offset == np.cumsum(lengths) - lengths).all()
        unknown = np.setdiff1d(rng.integers(-(2**63), 2**63 - 1, 1000), keys)
        assert not index.find(unknown, np.zeros(len(unknown), bool), np.zeros(len(unknown), np.int64))[0].any()


def test_null_and_least_key_are_two_keys(spark, tmp_path):
    rows = [(None, f"n{i}") for i in range(40)] + [(-(2**63), "least"), (-(2**63) + 1, "next"), (2**63 - 1, "most")] + [(i, f"t {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("x"), "start": F.lit(1)})
    for shards in (1, 3, 8):
        uri = f"file://{tmp_path}/s{shards}"
        token_store.write_store(df, uri, BPE, end_id=2, shards=shards)
        got = token_store.read_keys(spark, uri, df, with_ids=True).collect()
        assert sorted((str(r.doc_id), tuple(r.ids)) for r in got) == sorted((str(d), (*plain(t), 2)) for d, t in rows)


# sentencepiece


def test_codec_has_parity_and_round_trips(awkward):
    spm = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=SPM)
    rows = sentencepiece_codec.encode_documents(awkward, SPM, with_ids=True)
    texts = {(r.doc_id, r.text) for r in awkward.collect()}
    got = {(r.doc_id, tuple(r.ids)) for r in rows.collect()}
    assert got == {(d, tuple(spm.encode(t or ""))) for d, t in texts}
    back = {(r.doc_id, r.text) for r in sentencepiece_codec.decode_documents(rows, SPM).collect()}
    assert back == {(d, t or "") for d, t in texts}


def test_codec_of_nothing(nothing):
    assert sentencepiece_codec.encode_documents(nothing, SPM).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t中😀▁ .1", max_size=40))
def test_codec_parity_on_random_texts(text):
    codec = sentencepiece_codec.Codec.of(SPM)
    codec.verify(text, codec.encode_texts([text])[0])


def test_codec_parity_on_whole_random_texts():
    rng = random.Random(9)
    parts = [*"ab z0 \n,.'é▁中あ—\x00жΩ🙂\t", "  ", "abc", "Hello", " x", "\n\n", " \n "]
    codec = sentencepiece_codec.Codec(SPM)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    for text, ids in zip(texts, codec.encode_texts(texts), strict=True):
        codec.verify(text, ids)


def test_a_wrong_piece_is_an_error():
    codec = sentencepiece_codec.Codec(SPM)
    codec.reference = type("Other", (), {"encode": lambda self, texts: [[1]] * len(texts)})()
    with pytest.raises(ValueError, match="parity"):
        codec.encode_texts(["unheardof word"])


def _field(number, kind, value):
    out = bytes([number << 3 | kind])
    if kind == 2:
        n, size = len(value), b""
        while n > 127:
            size, n = size + bytes([n & 127 | 128]), n >> 7
        return out + size + bytes([n]) + value
    return out + (bytes([value]) if kind == 0 else value)


def test_unigram_model_from_its_protobuf(tmp_path):
    """A model written by hand: the best path by scores, and bytes for what no piece has."""
    import struct

    spm = pytest.importorskip("sentencepiece")
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, s, 1) for p, s in (("▁", -3.0), ("a", -4.0), ("b", -4.5), ("ab", -5.0), ("▁ab", -6.0), ("▁a", -5.5), ("ba", -5.2), ("aba", -8.9))]
    data = b"".join(_field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, k)) for p, s, k in pieces)
    data += _field(2, 2, _field(3, 0, 1) + b"\x98\x02\x01") + _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, 1) + _field(4, 0, 0) + _field(5, 0, 1))
    path = tmp_path / "m.model"
    path.write_bytes(data)
    codec = sentencepiece_codec.Codec(str(path))  # verifies the probes
    reference = spm.SentencePieceProcessor(model_file=str(path))
    for text in ("ab aba", "abba  ba", "aé", "ab" * 50):
        assert np.frombuffer(codec.encode_texts([text])[0], "<u4").tolist() == reference.encode(text)
        assert codec.decode(reference.encode(text)) == text
