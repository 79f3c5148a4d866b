"""Secret scans: fixed patterns, and a battery of randomness tests.  DataFrame functions only.

Base kinds, leftmost and non-overlapping each: ``assign`` (a named value of 12
or more characters), ``access`` (AKIA keys of 18 or more), ``hex`` (16 or more).

The battery takes every run of 20 or more token characters and infers its
encoding: the least of the known alphabets that holds it.  Three tests over its
symbols measure how far it is from random: chi-squared uniformity over the
alphabet, the number of runs above and below the alphabet's middle, and serial
correlation.  The token's p-value is that of a chi-squared as small as its own
if the token were text, in which two symbols are equal with a probability of
``REPEATS`` at least (noncentral chi-squared, Abdel-Aty's cube root); it is 1
where runs or correlation are more than ``OFF`` standard deviations from what
random symbols give, so all three must find it random.  False discoveries are
controlled by Benjamini-Hochberg at ``RATE`` over the whole corpus within strata
of encoding, kinds of characters and length, from a histogram of p-values
(rounded up, at most ``BINS`` a stratum).

All symbols of a token are tested.  One of more than ``LONG`` is tested by its
half-overlapping blocks of ``BLOCK``, strata of their own, so that what stands
before or after random symbols does not hide them; accepted blocks that meet are
one span.

A token within a base span is not tested; one that stretches beyond it is.  Work
grows with a text's length and matches, but for folds within chunks of ``CHUNK``.

Offsets are code points, end exclusive.  Defined results: a null text is empty;
rows with null or equal ids are scanned row by row; an empty table gives no
rows.  Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import durable

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A failing access or hex match holds no longer one, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings, least alphabet first: pattern, symbols in order.  Decimal numbers are not tested.
ENCODINGS = [
    ("decimal", "^[0-9]+$", _DIGITS),
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", "^[a-z0-9]+$", _DIGITS + _LOWER),
    ("BASE36", "^[A-Z0-9]+$", _DIGITS + _UPPER),
    ("base62", "^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", "^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    ("mixed", "", _UPPER + _LOWER + _DIGITS + "+/-_"),
]
#: Probability that two symbols of a token of text are equal, low enough for camel case with digits (in one case 0.065 and more), and the least effect for small alphabets.
REPEATS = 0.04
EFFECT = 1.0
OFF = 3.0
RATE = 0.05
BINS = 1500
BINS_PER_TENFOLD = 50
#: Tokens of more symbols are tested by blocks.
LONG = 512
BLOCK = 64
#: Elements that a fold appends one by one.
CHUNK = 256
_SPANS = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once (an array of one)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(items: Column) -> Column:
    """An array in chunks, so that a fold that appends copies no more than a chunk."""

    def cut(items: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))
        return F.when(F.size(items) > 0, chunks).otherwise(F.slice(F.array(items), 1, 0))

    return _once(items, cut)


def _before(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's numbers, the sum (or maximum: ``both``) of those before it; 0 before the first."""
    start = F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("out"))
    fold = lambda of: lambda acc, x: F.struct(both(acc["now"], of(x)).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))
    chunks = F.transform(_chunks(values), lambda c: F.aggregate(c, start, fold(lambda x: x)))

    def joined(chunks: Column) -> Column:
        bases = F.aggregate(chunks, start, fold(lambda c: c["now"]), lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, bases, lambda c, base: F.transform(c["out"], lambda x: both(base, x))))

    return _once(chunks, joined)


def _add(a: Column, b: Column) -> Column:
    return a + b


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the pattern's matches, those whose group is shorter than ``least`` dropped."""
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    rows = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("match"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
    size = lambda row: F.coalesce(F.char_length(row["match"]), F.lit(0))

    def span(row: Column, before: Column) -> Column:
        begin = before + row["gap"]
        return F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + size(row)).alias("stop"), row["value"].alias("value"))

    def found(rows: Column) -> Column:
        before = _before(F.transform(rows, lambda row: row["gap"] + size(row)), _add)
        return F.filter(F.zip_with(rows, before, span), lambda s: s["value"].isNotNull() & (F.char_length(s["value"]) >= least))

    return F.when(text.rlike(pattern), _once(rows, found)).otherwise(F.array().cast(_SPANS))


def _phi(z: Column) -> Column:
    """The normal distribution function, to about 1e-5 of itself in the tail that matters (logistic series)."""
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(1.5957691216 * z + 0.07056 * z * z * z, F.lit(-60.0)), F.lit(60.0))))


def _p_value(token: Column, encoding: Column) -> Column:
    """The chi-squared test's p-value, or 1 if another test finds the token not random."""
    symbols = F.lit(ENCODINGS[-1][2])
    for name, _, found in ENCODINGS[:-1]:
        symbols = F.when(encoding == name, found).otherwise(symbols)
    k = F.char_length(symbols).cast("double")
    values = F.transform(F.sequence(F.lit(1), F.char_length(token)), lambda i: (F.instr(symbols, F.substring(token, i, F.lit(1))) - 1).cast("double"))

    def sums(state: Column) -> Column:
        v, k = state["v"], state["k"]
        total = lambda of, items=v: F.aggregate(items, F.lit(0.0), lambda a, x: a + of(x))
        pairs = lambda of: total(lambda x: x, F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), of))
        high = lambda x: F.when(x >= k / 2, 1.0).otherwise(0.0)

        def equal(acc: Column, x: Column) -> Column:
            """In sorted symbols, a symbol's n-th place adds 2n - 1 to the sum of squares."""
            run = F.when(acc["last"] == x, acc["run"] + 2.0).otherwise(1.0)
            return F.struct(x.alias("last"), run.alias("run"), (acc["squares"] + run).alias("squares"))

        start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares"))
        return F.struct(
            F.size(v).cast("double").alias("n"), k.alias("k"), F.aggregate(F.sort_array(v), start, equal, lambda acc: acc["squares"]).alias("squares"),
            total(high).alias("n1"), pairs(lambda a, b: F.abs(high(a) - high(b))).alias("changes"),
            total(lambda x: x).alias("s1"), total(lambda x: x * x).alias("s2"), pairs(lambda a, b: a * b).alias("products"), (v[0] + F.element_at(v, -1)).alias("ends"),
        )

    def tests(t: Column) -> Column:
        n, k = t["n"], t["k"]
        chi = k / n * t["squares"] - n
        shift = n * F.greatest(k * REPEATS - 1, F.lit(EFFECT))
        centre = k - 1 + shift
        part = 2.0 / 9.0 * (1 + shift / centre) / centre
        p_chi = _phi((F.pow(chi / centre, F.lit(1.0 / 3.0)) - (1 - part)) / F.sqrt(part))
        mean_runs = 1 + 2 * t["n1"] * (n - t["n1"]) / n
        sd_runs = F.sqrt(F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), n / 16))
        runs = F.abs(t["changes"] + 1 - mean_runs) <= OFF * sd_runs
        mean = t["s1"] / n
        spread = t["s2"] - n * mean * mean
        both = t["products"] - mean * (2 * t["s1"] - t["ends"]) + (n - 1) * mean * mean
        serial = (spread > 0) & (F.abs(both) * F.sqrt(n) <= OFF * spread)
        return F.when(runs & serial, p_chi).otherwise(1.0)

    return _once(_once(F.struct(values.alias("v"), k.alias("k")), sums), tests)


def _encoding(token: Column) -> Column:
    out = F.lit(ENCODINGS[-1][0])
    for name, pattern, _ in reversed(ENCODINGS[:-1]):
        out = F.when(token.rlike(pattern), name).otherwise(out)
    return out


def _stratum(encoding: Column, token: Column, block: Column) -> Column:
    """Encoding, kinds of characters, and length class."""
    length = F.char_length(token)
    kinds = F.concat(*(F.when(token.rlike(p), x).otherwise("") for p, x in (("[A-Z]", "A"), ("[a-z]", "a"), ("[0-9]", "0"))))
    lengths = F.when(length < 24, "20").when(length < 32, "24").when(length < 48, "32").when(length < 96, "48").otherwise("96")
    return F.concat_ws(":", encoding, kinds, F.when(block, "block").otherwise(lengths))


def _blocks(t: Column) -> Column:
    """A token as it is, or the half-overlapping blocks of a long one; the last ends where the token ends."""
    half = BLOCK // 2

    def blocks(parts: Column) -> Column:
        n = F.char_length(t["value"])
        last = F.ceil((n - BLOCK) / half).cast("int")  # number of the last block

        def block(i: Column) -> Column:
            at = F.least(i * half, n - BLOCK)
            tail = F.substring(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), ""), F.lit(-BLOCK), F.lit(BLOCK))
            value = F.when(i < last, F.concat(F.element_at(parts, i + 1), F.element_at(parts, i + 2))).otherwise(tail)
            return F.struct((t["start"] + at).alias("start"), t["kind"].alias("kind"), (t["start"] + at + BLOCK).alias("stop"), value.alias("value"), F.lit(True).alias("block"))

        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), block)

    whole = F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["stop"].alias("stop"), t["value"].alias("value"), F.lit(False).alias("block"))
    parts = F.regexp_extract_all(t["value"], F.lit(f".{{1,{half}}}"), F.lit(0))
    return F.when(F.char_length(t["value"]) > LONG, _once(parts, blocks)).otherwise(F.array(whole))


def _groups(spans: Column, touching: bool) -> Column:
    """Spans in order, those that overlap (or touch) together: ``start, kind, stop`` of each group."""

    def grouped(both: Column) -> Column:
        spans, reach = both["spans"], both["reach"]
        apart = lambda i: spans[i]["start"] > reach[i] if touching else spans[i]["start"] >= reach[i]
        firsts = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | apart(i))

        def group(firsts: Column) -> Column:
            after = F.concat(F.slice(firsts, 2, F.size(firsts)), F.array(F.lit(-1)))
            end = lambda i: F.when(i < 0, F.array_max(F.transform(spans, lambda s: s["stop"]))).otherwise(reach[i])
            return F.zip_with(firsts, after, lambda i, nxt: F.struct(spans[i]["start"].alias("start"), spans[i]["kind"].alias("kind"), end(nxt).alias("stop")))

        return _once(firsts, group)

    reach = _before(F.transform(spans, lambda s: s["stop"]), F.greatest)
    found = _once(F.struct(spans.alias("spans"), reach.alias("reach")), grouped)
    return F.when(F.size(spans) > 0, found).otherwise(F.array().cast("array<struct<start:int,kind:int,stop:int>>"))


def _uncovered(base: Column, tokens: Column) -> Column:
    """The tokens that no base span holds whole."""
    item = lambda is_token: lambda s: F.struct(s["start"].alias("start"), F.lit(is_token).alias("token"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value"))

    def kept(items: Column) -> Column:
        reach = _before(F.transform(items, lambda s: F.when(s["token"] == 0, s["stop"]).otherwise(0)), F.greatest)
        reached = F.zip_with(items, reach, lambda s, r: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["value"].alias("value"), ((s["token"] == 1) & (s["stop"] > r)).alias("new")))
        return F.filter(reached, lambda s: s["new"])

    # one that holds a token starts at it or before it
    items = F.sort_array(F.concat(F.transform(base, item(0)), F.transform(tokens, item(1))))
    return F.when(F.size(tokens) > 0, _once(items, kept)).otherwise(F.array().cast("array<struct<start:int,kind:int,stop:int,value:string,new:boolean>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc_id``, the columns to carry, ``base`` spans, and ``tests``: candidates with stratum and p-value."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    base = F.sort_array(F.concat(_spans(text, ASSIGN, 0, 1, 12), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *(F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry or [])))
    found = source.withColumns({"base": base, "tokens": _spans(text, TOKEN, 3)})
    new = _once(F.struct("base", "tokens"), lambda both: _uncovered(both["base"], both["tokens"]))

    def test(t: Column) -> Column:
        def tested(e: Column) -> Column:
            p = F.when(e["encoding"] == "decimal", 1.0).otherwise(_p_value(e["value"], e["encoding"]))
            return F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["stop"].alias("stop"), _stratum(e["encoding"], e["value"], t["block"]).alias("stratum"), p.alias("p"))

        return _once(F.struct(_encoding(t["value"]).alias("encoding"), t["value"].alias("value")), tested)

    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["stop"].alias("stop")))
    return found.select("doc_id", *(c for c in found.columns if c.startswith("carry_")), plain.alias("base"), F.transform(F.flatten(F.transform(new, _blocks)), test).alias("tests"))


def thresholds(scanned: DataFrame, rate: float = RATE) -> dict[str, int]:
    """For each stratum the least bin of p-values that Benjamini-Hochberg accepts."""
    tested = scanned.select(F.explode("tests").alias("t")).select("t.stratum", _bin(F.col("t.p")).alias("bin"))
    counts = tested.groupBy("stratum", "bin").count().collect()  # a fixed number of strata and bins
    out = {}
    for stratum in {r.stratum for r in counts}:
        bins = sorted(((r.bin, r["count"]) for r in counts if r.stratum == stratum), reverse=True)
        m, seen = sum(n for _, n in bins), 0
        for b, n in bins:
            seen += n
            if 10.0 ** (-b / BINS_PER_TENFOLD) <= rate * seen / m:
                out[stratum] = b
    return out


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * BINS_PER_TENFOLD), F.lit(BINS)).cast("int")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, rate: float = RATE) -> DataFrame:
    """``doc_id``, the columns to carry, ``base`` and ``spans``: arrays of ``start, kind, stop`` in order."""
    kept = ["doc_id", *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry or []))]
    scanned = scan(docs, id_col, text_col, carry)
    # without the texts
    limits = thresholds(durable(scanned.where("size(tests) > 0").select("tests"), "tests"), rate)
    if limits:
        by = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
        accepted = F.filter("tests", lambda t: F.coalesce(_bin(t["p"]) >= F.element_at(by, t["stratum"]), F.lit(False)))
    else:
        accepted = F.filter("tests", lambda t: F.lit(False))
    added = _groups(accepted, touching=True)
    return scanned.select(*kept, "base", F.sort_array(F.concat("base", added)).alias("spans"))


def as_text(spans: str) -> Column:
    """``kind:start:end``, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def masked(text: Column, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with each span (overlapping ones together) replaced by the mark."""

    def pieces(groups: Column) -> Column:
        last = lambda chunk: F.element_at(chunk, -1)
        chunks = _chunks(groups)

        def cut(both: Column) -> Column:
            chunks, begins = both["chunks"], both["begins"]

            def chunk(c: Column, i: Column) -> Column:
                base = begins[i]

                def cuts(given: Column) -> Column:
                    before = given["before"]
                    return F.transform(c, lambda g, k: F.substring(given["part"], before[k] - base + 1, g["start"] - before[k]))

                part = F.substring(text, base + 1, last(c)["start"] - base)
                return _once(F.struct(part.alias("part"), F.concat(F.array(base), F.transform(c, lambda g: g["stop"])).alias("before")), cuts)

            end = F.element_at(begins, -1)
            return F.array_join(F.concat(F.flatten(F.transform(chunks, chunk)), F.array(F.substring(text, end + 1, F.char_length(text)))), mark)

        begun = lambda chunks: F.struct(chunks.alias("chunks"), F.concat(F.array(F.lit(0)), F.transform(chunks, lambda c: last(c)["stop"])).alias("begins"))  # noqa: E731  where each chunk's text begins
        return _once(_once(chunks, begun), cut)

    return F.when(F.size(spans) > 0, _once(_groups(F.col(spans), touching=False), pieces)).otherwise(text)
