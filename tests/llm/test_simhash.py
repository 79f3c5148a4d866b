import random

import pytest
import xxhash

from millrace.llm import simhash
from millrace.llm.components import stars


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, tau):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= tau:
                root[find(max(a, b))] = find(min(a, b))
    return {f: find(f) for f in fps}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, bin long")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(df).collect()}
    fps = {d: brute_fingerprint(t) for d, t, *_ in rows}
    comp = brute_components(set(fps.values()), 3)
    least = {}
    for d, f in fps.items():
        least[comp[f]] = min(d, least.get(comp[f], d))
    assert got == {(d, f"{f:016x}"): least[comp[f]] for d, f in fps.items()}


def test_words_edges_and_clashing_columns(spark):
    texts = ["", None, "a", "A", "a b", " a\tB ", "a b c", "x y z", "Ünï CÖDE is kept", "w " * 5000, "one two three four"] * 2
    check(spark, [(i, t, "x", 1) for i, t in enumerate(texts)])


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "q r s t")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == [("4", "4"), ("None", "4"), ("None", "None")]


@pytest.mark.parametrize("most, cost, tau", [(4096, 40.0, 3), (4096, 0.001, 3), (20, 40.0, 3), (4, 0.5, 3), (4096, 40.0, 7), (60, 40.0, 7), (4096, 40.0, 5)])
def test_links_join_what_brute_force_joins(spark, monkeypatch, most, cost, tau):
    monkeypatch.setattr(simhash, "MOST_IN_GROUP", most)
    monkeypatch.setattr(simhash, "PROBE_COST", cost)
    rng = random.Random(most)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(fps)[:6]:
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64 if centre % 2 else 20), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    classes = spark.createDataFrame([(s, s) for s in signed.values()], "fp long, node long")
    got = {r.u: r.v for r in stars(simhash.links(classes, tau)).collect()}
    want = brute_components(fps, tau)
    groups = {}
    for f, root in want.items():
        groups.setdefault(root, set()).add(signed[f])
    assert {s: got.get(s, s) for s in signed.values()} == {s: min(g) for g in groups.values() for s in g}


def test_confirmed_near_copies(spark):
    """Texts of which one word in sixty is changed are linked; unrelated and half-changed ones are not."""
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 5000))
    rows, groups = [], []
    for g in range(40):
        words = [word() for _ in range(180)]
        group = []
        for c in range(4):
            copy = list(words)
            for i in rng.sample(range(180), 0 if c == 0 else 2 if c < 3 else 60):
                copy[i] = word()
            rows.append((len(rows), " ".join(copy)))
            group.append(len(rows) - 1)
        groups.append(group)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, tau=7, confirm=simhash.Confirm()).collect()}
    caught = sum(got[d] == g[0] for g in groups for d in g[1:3])
    assert caught >= 0.95 * 80
    assert all(got[g[3]] == g[3] and got[g[0]] == g[0] for g in groups)
