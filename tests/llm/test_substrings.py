import hashlib
import random

import pytest

from millrace.llm import substrings


def brute(rows, window=13):
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, words in docs:
        rank = substrings.HIGHEST if d is None else d
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(rank, first.get(w, rank))
    out = []
    for d, words in docs:
        rank = substrings.HIGHEST if d is None else d
        gone = {i + k for i in range(len(words) - window + 1) if first[tuple(words[i : i + window])] < rank for k in range(window)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "été", "den", "of", "x" * 40]) + str(rng.randint(0, 30))
    passages = [[word() for _ in range(rng.randint(11, 60))] for _ in range(8)]
    rows = []
    for d in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 40))]
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(d, rows[rng.randrange(n)][1]) for d in range(n, n + 20)]
    rows += [(3, rows[3][1]), (5, "other " + rows[3][1]), (None, rows[7][1]), (n + 50, None), (n + 51, ""), (n + 52, "w " * 3000), (n + 53, "w " * 3000)]
    return rows


@pytest.mark.parametrize("hot, words", [(1000, 150_000), (3, 500), (0, 2000)])
def test_same_as_brute_force(spark, monkeypatch, hot, words):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", words)
    rows = fixture(hot)
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, a string, rank int")
    got = sorted((tuple(r) for r in substrings.remove_repeats(df).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_carried_columns_and_texts(spark):
    long = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, long, "x"), (2, f"keep\n{long} this", "y"), (3, "as\n\nis", None)], "doc_id long, text string, first string")
    got = {r.doc_id: (r.text, r["first"]) for r in substrings.remove_repeats(df, carry=["first"]).collect()}
    assert got == {1: (long, "x"), 2: ("keep this", "y"), 3: ("as\n\nis", None)}


def test_query_matches_sql(spark):
    from oracle import compare, connect

    from millrace.llm import queries

    sf = "/root/testdata/sf0.001"
    compare(queries.op8_substring_dedup(spark, sf), connect(sf), queries.oracle_sql()["op8_substring_dedup"])
