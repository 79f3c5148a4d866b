"""The five stages against a brute-force version on small tables."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import quality
from millrace.llm.queries import tokenizer_file

from .test_corpus_operators import brute_base, brute_secrets
from .test_substrings import brute as brute_substrings
from .test_tokens import check_packing


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of words, with copies, near copies, shared passages, secrets and junk; some labels."""
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice(["an", "el", "or", "ith", "ou"]) + str(rng.randint(0, 40))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(60):
        texts.append(" ".join(word() for _ in range(rng.randint(60, 140))))
    texts += texts[:5] + [texts[0]] * 10  # exact copies
    for t in texts[5:10]:  # near copies
        words = t.split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [" ".join(word() for _ in range(50)) + " " + passage + " " + " ".join(word() for _ in range(50)) for _ in range(6)]
    texts += [" ".join(word() for _ in range(40)) + f" token={hashlib.sha256(bytes([i])).hexdigest()} " + " ".join(word() for _ in range(40)) for i in range(4)]
    junk = ["short text", "", None, "again and again " * 40, " ".join("buy$$$ now!!! click###".split()[i % 3] for i in range(15))]
    texts += junk
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, len(texts) - len(junk), 3)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, len(texts) - len(junk)


def test_stages_against_brute_force(spark, tables):
    path, rows, first_junk = tables
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{path}/documents.parquet")

    kept = stages["quality_rules"](spark, docs, path)
    assert kept.columns == corpus_pipeline.COLUMNS
    found = kept.collect()
    verdicts = {r.doc_id: r.score for r in quality.judge(docs, spark.read.parquet(f"{path}/labels.parquet")).collect()}
    want = {d for d, t, *_ in rows if not brute_base(t)[-1] and verdicts[d] >= quality.THRESHOLD}
    assert {r.doc_id for r in found} == want and all(d < first_junk for d in want) and len(want) >= first_junk - 1

    single = stages["near_duplicates"](spark, kept, path)
    assert single.columns == corpus_pipeline.COLUMNS
    found = single.collect()
    before = {r.doc_id: r.text for r in kept.collect()}
    words = {d: t.lower().split() for d, t in before.items()}
    shingles = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in words.items()}
    root = {d: d for d in before}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sorted(before):
        for b in sorted(before):
            if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert {r.doc_id for r in found} == {d for d in before if top(d) == d}

    cut = stages["substring_dedup"](spark, single, path)
    found = {r.doc_id: r for r in cut.collect()}
    reference = {d: (n, gone, sha) for d, n, gone, sha in brute_substrings([(r.doc_id, r.text) for r in single.collect()])}
    assert set(found) == {d for d, (n, gone, _) in reference.items() if gone < n or not gone}
    assert sum(gone >= 13 for _, gone, _ in reference.values()) >= 5
    for d, r in found.items():
        assert hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest() == reference[d][2] and r.n_chars == len(r.text)

    masked = stages["secret_scans"](spark, cut, path)
    assert masked.columns == corpus_pipeline.COLUMNS
    for r in masked.collect():
        assert not brute_secrets(r.text) and r.n_chars == len(r.text)
        if not brute_secrets(found[r.doc_id].text):
            assert r.text == found[r.doc_id].text

    packed = stages["best_fit_packing"](spark, masked, path).collect()
    check_packing(packed, [(r.doc_id, r.text) for r in masked.collect()], 2048)


def test_run_gives_the_last_stage(spark, tables):
    path, rows, _ = tables
    out = corpus_pipeline.run(spark, path)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    sizes = {}
    for r in out.collect():
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert max(sizes.values()) <= 2048 and len(sizes) <= np.ceil(sum(sizes.values()) / 2048) + 1


def test_empty_documents(spark, tables, tmp_path):
    path, *_ = tables
    empty = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0, name


def test_tokenizer_path():
    assert tokenizer_file("byte_bpe_50k.json").endswith("byte_bpe_50k.json")
