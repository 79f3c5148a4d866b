import random

import corpus_pipeline
from millrace.llm import near


def brute(texts, similarity=0.8):
    """The component of each text, and its sets."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def corpus(rng, groups=60, copies=5):
    """Chains of edits, of similarities from 0.6 to 0.95."""
    texts = []
    for _ in range(groups):
        words = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
        texts.append(" ".join(words))
        for _ in range(copies):
            words = list(words)
            for i in rng.sample(range(200), rng.choice([1, 3, 4, 5, 6, 8, 10])):
                words[i] = f"w{rng.randint(0, 9999)}"
            texts.append(" ".join(words))
    return texts


def kept_ids(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}


def test_links_are_exactly_those_of_the_similarity(spark):
    texts = corpus(random.Random(3))
    assert kept_ids(spark, texts) == set(brute(texts))


def test_refuted_links_of_a_large_group_cost_no_link(spark):
    """Copies of one text in a star: each near the centre or not, few near each other."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
    texts = []
    for _ in range(150):
        words = list(base)
        for i in rng.sample(range(200), rng.choice([2, 4, 5, 6, 8, 9])):
            words[i] = f"v{rng.randint(0, 9999)}"
        texts.append(" ".join(words))
    assert kept_ids(spark, texts) == set(brute(texts))


def test_repeated_words_do_not_hide_different_sets(spark):
    rng = random.Random(5)
    texts = ["spam " * 400 + " ".join(f"w{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(12)]
    assert kept_ids(spark, texts) == set(brute(texts)) == set(range(12))


def test_one_row_of_a_component_is_kept(spark):
    """Also without ids, and where texts share an id."""
    rng = random.Random(6)
    a, b, c = (" ".join(f"w{rng.randint(0, 9999)}" for _ in range(150)) for _ in range(3))
    rows = [(None, a), (None, a + " x"), (None, a), (None, b), (5, b + " x"), (None, b + " y"), (7, c), (7, c + " x"), (7, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in out) == ["5", "7", "None"]
    assert next(r.text for r in out if r.doc_id == 5) == b + " x"


def test_recall_does_not_hang_on_the_table():
    """Of 2000 pairs just above 0.8, bands miss few; the SimHash's allowance drops none."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(1))
    met = passed = 0
    for _ in range(2000):
        x = rng.integers(0, 1 << 64, 200, dtype=np.uint64)
        y = np.concatenate([x[:178], rng.integers(0, 1 << 64, 22, dtype=np.uint64)])  # 178 of 222
        met += bool((near.bands(x) == near.bands(y)).any())
        longs = [[np.array([near.simhash.majority(near.mix(s + o)) for s in (x, y)], np.uint64)] for o in near.simhash._OFFSETS]
        passed += bool(near._Near(np.array([200, 200]), [c for (c,) in longs], 0.8)(0, np.array([1]))[0])
    assert met >= 1998 and passed >= 1999


def test_sets_simhashes_and_bands_are_those_of_single_texts():
    """Blocks of many texts give what each text alone gives, and sets of the texts' shingles."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    texts = ["", None, "a", "A b", "a b c d", "a b c d e", "x " * 9, "\t \n"] + [" ".join(rng.choice("abcD") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts.append(" ".join(f"w{rng.randint(0, 50_000)}" for _ in range(200_000)))  # over a megabyte
    sets = []
    for _, found, counts in near.shingle_sets(pa.array(texts)):
        sets += np.split(found, np.cumsum(counts)[:-1])
    words = [(t or "").lower().split() for t in texts]
    want = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(len(texts) - 1):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])
    full = [s for s in sets if len(s)]
    firsts = np.cumsum([0] + [len(s) for s in full[:-1]])
    longs, keys = near.long_simhashes(np.concatenate(full), firsts), near.bands(np.concatenate(full), firsts)
    for s, own, k in zip(full, longs, keys, strict=True):
        assert own.tolist() == [near.simhash.majority(near.mix(s + o)) for o in near.simhash._OFFSETS]
        assert k.tolist() == near.bands(s)[0].tolist()


def test_null_columns_and_clashing_names(spark):
    rng = random.Random(9)
    a = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(150))
    rows = [(1, a, None, None, None, 5, 1), (2, a + " more", "en", None, 3, 6, 2), (None, None, None, None, None, None, None), (None, "", None, None, None, 1, 1), (3, "  ", "x", "y", 2, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, bands long")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == ["1", "3"]


def test_simhash_links_are_candidates(spark):
    """Fingerprints within three bits are found by the SimHash's own search, whatever the bands give."""
    texts = corpus(random.Random(10), groups=20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = near.described(docs, "doc_id", "text", 5)
    prints = {r.node: r.c0 & (2**64 - 1) for r in classes.collect()}
    found = [(r.u, r.v) for r in near.simhash_candidates(classes).collect()]
    root = {n: n for n in prints}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in found:
        assert (prints[u] ^ prints[v]).bit_count() <= near.TAU
        root[top(u)] = top(v)
    close = [(u, v) for u in prints for v in prints if u < v and (prints[u] ^ prints[v]).bit_count() <= near.TAU]
    assert close and all(top(u) == top(v) for u, v in close)


def test_rounds_of_nearest_candidates_lose_no_link_and_compare_few(spark, monkeypatch):
    """A large group of near copies of which some are near few others: all links, by fewer comparisons than half of the pairs."""
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
    texts = []
    for i in range(400):
        words = list(texts[-1].split() if texts and i % 40 == 1 else base)
        for j in rng.sample(range(200), rng.choice([2, 3, 4, 5, 6, 7, 12])):
            words[j] = f"v{rng.randint(0, 99999)}"
        texts.append(" ".join(words))
    compared, plain = [], near.compared

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(near, "compared", counting)
    monkeypatch.setattr(near, "NEAREST", 4)
    assert kept_ids(spark, texts) == set(brute(texts))
    assert len(compared) > 2 and sum(compared) < 400 * 399 / 2 / 2


def test_texts_below_the_similarity_are_joined_not_compared_pair_by_pair(spark, monkeypatch):
    """Of a large group most of whose pairs lie just below 0.8, sets meet by what is rare: all links, and under a twentieth of the pairs."""
    rng = random.Random(13)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
    texts = []
    for i in range(400):
        words = list(texts[-1].split() if i % 10 == 1 else base)
        for j in rng.sample(range(len(words)), 5 if i % 10 else rng.choice([2, 8])):
            words[j] = f"v{i}_{j}"
        texts.append(" ".join(words[rng.randint(0, 4) :]))
    pairs, plain = [], near.compared

    def counting(these, *rest):
        pairs.append(these.count())
        return plain(these, *rest)

    monkeypatch.setattr(near, "compared", counting)
    assert kept_ids(spark, texts) == set(brute(texts))
    assert sum(pairs[1:]) < 400 * 399 / 2 / 20


def test_bands_are_dealt_out_once(spark, monkeypatch):
    """However many groups have refuted links, only the first search makes a row for each text's band."""
    made, plain = [], near.F.explode
    monkeypatch.setattr(near.F, "explode", lambda c: made.append(c) or plain(c))
    plans, write = [], near.durable
    monkeypatch.setattr(near, "durable", lambda df, name: plans.append((name, df._jdf.queryExecution().analyzed().toString())) or write(df, name))
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
    texts = []
    for _ in range(100):
        words = list(base)
        for i in rng.sample(range(200), rng.choice([2, 4, 5, 6, 8, 9])):
            words[i] = f"v{rng.randint(0, 9999)}"
        texts.append(" ".join(words))
    assert kept_ids(spark, texts) == set(brute(texts))
    assert any(name == "again" for name, _ in plans)
    assert [name for name, plan in plans if "explode(bands" in plan] == ["candidates"]
