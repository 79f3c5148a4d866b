import math
import random
import re
import time

from pyspark.sql import functions as F

from millrace.llm import secrets

from .test_corpus_operators import brute_secrets

BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
WORDS = "internationalization configuration settings of the which report number people government question development between another available community management information business support service program research".split()


def spans(spark, rows):
    return {r.doc_id: [(s.start, s.stop) for s in r.spans if s.kind == 3] for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def text_token(rng, joint="-"):
    out = rng.choice(WORDS)
    while len(out) < 20:
        out += joint + rng.choice(WORDS)
    return out


def camel(rng):
    return "".join(w.title() for w in text_token(rng).split("-"))


def added(rng, lengths):
    return [(100_000 + 1000 * n + i, "key " + "".join(rng.choice(BASE62) for _ in range(n)) + " end") for n in lengths for i in range(30)]


def counted(got, lengths):
    return [sum(bool(got[100_000 + 1000 * n + i]) for i in range(30)) for n in lengths], sum(bool(x) for d, x in got.items() if d < 100_000)


def test_random_tokens_of_one_percent_are_found(spark):
    """20, 32 and 40 random symbols among a hundred times as many tokens of text."""
    rng, lengths = random.Random(3), (20, 32, 40)
    rows = [(i, "see " + (camel(rng) if i % 3 == 0 else text_token(rng)) + " there") for i in range(9000)]
    found, wrong = counted(spans(spark, rows + added(rng, lengths)), lengths)
    assert min(found) >= 20 and wrong <= 0.1 * sum(found)


def test_text_with_digits_is_left_and_longer_keys_are_found(spark):
    """A sixth of the text is camel case with digits, the likest to random symbols; 20 of those can't be told from it."""
    rng, lengths = random.Random(3), (32, 40)
    rows = [(i, "see " + (text_token(rng) if i % 3 else camel(rng) + (str(rng.randint(1, 99)) if i % 2 else "")) + " there") for i in range(9000)]
    found, wrong = counted(spans(spark, rows + added(rng, lengths)), lengths)
    assert min(found) >= 20 and wrong <= 0.1 * sum(found)


def test_random_symbols_behind_a_long_head_are_found(spark):
    rng = random.Random(4)
    key = lambda n: "".join(rng.choice(BASE62) for _ in range(n))
    rows = [(i, "A" * 700 + key(200)) for i in range(10)]
    rows += [(10 + i, "/".join(rng.choice(WORDS) for _ in range(120)) + "/" + key(200)) for i in range(10)]
    rows += [(20 + i, key(200) + "A" * 700) for i in range(10)]
    rows += [(30 + i, "/".join(rng.choice(WORDS) for _ in range(200))) for i in range(10)]
    got = spans(spark, rows)
    text = dict(rows)
    for i in range(30):
        (span,) = got[i]
        n = len(text[i])
        lo, hi = (0, 200) if i >= 20 else (n - 200, n)
        assert abs(span[0] - lo) <= 64 and abs(span[1] - hi) <= 64
    assert not any(got[i] for i in range(30, 40))


def brute_p(token, symbols):
    """The three tests on one token, from their definitions."""
    v, k, n = [symbols.index(c) for c in token], len(symbols), len(token)
    chi = sum((v.count(s) - n / k) ** 2 / (n / k) for s in range(k))
    shift = n * max(k * secrets.REPEATS - 1, secrets.EFFECT)
    centre = k - 1 + shift
    part = 2 / 9 * (1 + shift / centre) / centre
    z = ((chi / centre) ** (1 / 3) - (1 - part)) / math.sqrt(part)
    p = 1 / (1 + math.exp(-min(max(1.5957691216 * z + 0.07056 * z**3, -60), 60)))
    high = [x >= k / 2 for x in v]
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    n1 = sum(high)
    mean = 1 + 2 * n1 * (n - n1) / n
    sd = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), n / 16))
    m = sum(v) / n
    spread = sum((x - m) ** 2 for x in v)
    serial = sum((a - m) * (b - m) for a, b in zip(v, v[1:], strict=False))
    return p if abs(runs - mean) <= secrets.OFF * sd and spread > 0 and abs(serial) * math.sqrt(n) <= secrets.OFF * spread else 1.0


def brute_spans(rows):
    """The added spans of each text, from the rules in the module's words."""
    tests = []
    for d, text in rows:
        base = [(a, b) for a, _, b in brute_secrets(text)]
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", text or ""):
            if any(a <= m.start() and m.end() <= b for a, b in base):
                continue
            n = len(m[0])
            places = [(0, n)] if n <= secrets.LONG else [(min(i, n - secrets.BLOCK), min(i, n - secrets.BLOCK) + secrets.BLOCK) for i in range(0, n - secrets.BLOCK // 2, secrets.BLOCK // 2)]
            for a, b in places:
                token = m[0][a:b]
                name, symbols = next((name, symbols) for name, pattern, symbols in secrets.ENCODINGS if re.match(pattern, token))
                p = 1.0 if name == "decimal" else brute_p(token, symbols)
                kinds = "".join(x for x, r in (("A", "[A-Z]"), ("a", "[a-z]"), ("0", "[0-9]")) if re.search(r, token))
                length = "block" if n > secrets.LONG else str(max(x for x in (20, 24, 32, 48, 96) if x <= len(token)))
                tests.append((d, m.start() + a, m.start() + b, (name, kinds, length), min(math.floor(-math.log10(max(p, 1e-30)) * secrets.BINS_PER_TENFOLD), secrets.BINS)))
    out = {d: [] for d, _ in rows}
    for stratum in {t[3] for t in tests}:
        own = sorted((t for t in tests if t[3] == stratum), key=lambda t: -t[4])
        bins = [t[4] for t in own]
        good = [b for b in bins if 10 ** (-b / secrets.BINS_PER_TENFOLD) <= secrets.RATE * sum(x >= b for x in bins) / len(own)]
        for d, a, b, _, x in own:
            if good and x >= min(good):
                out[d].append((a, b))
    for d, found in out.items():
        joined = []
        for a, b in sorted(found):
            if joined and joined[-1][1] >= a:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
            else:
                joined.append((a, b))
        out[d] = joined
    return out


def test_battery_against_its_definitions(spark):
    rng = random.Random(5)
    key = lambda n, symbols=BASE62: "".join(rng.choice(symbols) for _ in range(n))
    rows = []
    for d in range(1500):
        parts = [rng.choice(["see", "été", "\n", "a, b"])]
        for _ in range(rng.randint(0, 3)):
            parts.append(rng.choice([text_token(rng), text_token(rng, "_"), camel(rng), key(rng.randint(20, 70)), key(40, "0123456789abcdef"), key(30, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), "1" * 25]))
        if d % 7 == 0:
            parts.append("token=" + key(30) + rng.choice(["", ".", "/" + key(20)]))
        if d % 11 == 0:
            parts.append(key(12, "GHIJK") + key(20, "0123456789abcdef") + key(12))  # stretches beyond a hex span
        if d % 101 == 0:
            parts.append(text_token(rng, "_") * 30 + key(200))
        rows.append((d, " ".join(parts)))
    rows += [(9001, None), (9002, "")]
    want = brute_spans(rows)
    got = spans(spark, rows)
    assert [(d, t, got[d], want[d]) for d, t in rows if got[d] != want[d]] == []
    assert sum(map(bool, want.values())) > 300


def test_tokens_that_stretch_beyond_a_base_span_are_tested(spark):
    rng = random.Random(6)
    key = lambda n: "".join(rng.choice(BASE62) for _ in range(n))
    rows = [(i, "see " + key(30) + "+" + "0123456789abcdef" + "+" + key(30)) for i in range(30)]
    got = spans(spark, rows)
    assert sum(bool(x) for x in got.values()) >= 25


def test_a_text_of_many_matches_and_a_token_of_megabytes(spark):
    """Work grows with the text: 100,000 matches, and one token of two million symbols random at its end alone."""
    rng = random.Random(7)
    key = lambda n: "".join(rng.choice(BASE62) for _ in range(n))
    hexes = ["%016x" % rng.getrandbits(64) for _ in range(100_000)]
    many = "é ".join(hexes)
    long = "/".join(rng.choice(WORDS) for _ in range(200_000)) + "/" + key(200)
    df = spark.createDataFrame([(1, many), (2, long), (3, "plain")], "doc_id long, text string")
    start = time.time()
    found = secrets.find(df, carry=["text"])
    got = {r.doc_id: r for r in found.select("doc_id", "base", "spans", secrets.masked(F.col("text"), "spans").alias("m")).collect()}
    assert time.time() - start < 240
    assert [(s.start, s.stop) for s in got[1].base] == [(18 * i, 18 * i + 16) for i in range(100_000)]
    assert got[1].m == "é ".join(["[SECRET]"] * 100_000) and got[3].m == "plain"
    (span,) = got[2].spans
    assert abs(span.start - (len(long) - 200)) <= 64 and span.stop >= len(long) - 64
    assert got[2].m == long[: span.start] + "[SECRET]" + long[span.stop :]
