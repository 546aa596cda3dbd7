"""Secrets in text: named patterns, and strings that pass a battery of randomness tests.

All in DataFrame operations. A candidate is a run of characters of the base64 and url alphabets
with a letter, and the padding at its end; any other '=' parts candidates, so a name and the
value set to it are tested on their own. Its encoding (hex, base32, letters, base62, base64) is
inferred from the characters it uses; a run shorter than `bits` of information in its encoding
is not tested. Under the hypothesis that its characters are drawn evenly from that alphabet,
three tests give z values: chi-squared uniformity (with the exact moments of
small samples), runs above and below the alphabet's middle, and serial correlation. Their
p-values are combined by Fisher's method. Benjamini and Hochberg's step-up rule, applied among
candidates of like length and encoding over the whole corpus, decides which strings are
declared not random; the share of random strings among those is held to `level` at every length.
The rest are reported as kind `random`.

Defined results
* Null text: no span. Offsets are code points, ends exclusive.
* A random span that touches a pattern's span is left out; pattern spans always stay.
* Repeated rows are scanned alone and alike, except that each counts as a candidate.
* Empty table: no row. Extra columns stay; those named like results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import bind, indexes

#: Fixed values of the task: kinds in order, their patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "random")

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: name, pattern, alphabet; the first that matches is taken.
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + "234567"),
    ("letters", r"^[A-Za-z]+$", UPPER + LOWER),
    ("base62", r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", r".", UPPER + LOWER + DIGITS + "+/"),
)
LEVEL = 0.05
BITS = 80.0
#: The least length that carries BITS in some encoding, then padding that nothing follows.
LEAST_RUN = math.ceil(BITS / math.log2(max(len(alphabet) for _, _, alphabet in ENCODINGS)))
CANDIDATE = (
    rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_RUN},}}+(?:={{1,6}}(?![A-Za-z0-9+/=_-]))?"
)
#: p-values are counted in steps of a tenth of their decimal logarithm, down to 1e-30.
STEPS, DEEPEST = 10, 30
GROUP = 128


def running_sums(values: Column) -> Column:
    """Sum of all values before each, in two levels so that long arrays stay cheap."""
    add = lambda a, x: a + x
    total = lambda part: F.aggregate(part, F.lit(0), add)

    def in_groups(v: Column) -> Column:
        groups = F.transform(
            indexes(0, F.floor((F.size(v) - 1) / GROUP).cast("int")), lambda g: total(F.slice(v, g * GROUP + 1, GROUP))
        )
        before = lambda gs: F.transform(gs, lambda _, g: total(F.slice(gs, F.lit(1), g)))

        def place(starts: Column) -> Column:
            group = lambda i: F.floor(i / GROUP).cast("int")
            return F.transform(
                v, lambda _, i: F.get(starts, group(i)) + total(F.slice(v, group(i) * GROUP + 1, F.pmod(i, F.lit(GROUP))))
            )

        return bind(bind(groups, before), place)

    return bind(values, in_groups)


SPAN = "array<struct<start:int,kind_no:int,end:int,hit:string>>"


def spans_of(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """All leftmost, non-overlapping matches as (start, kind_no, end, hit)."""

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        sizes = lambda g: F.transform(hits, lambda h, i: F.get(g, i) + F.length(h))
        both = bind(gaps, lambda g: F.arrays_zip(g.alias("gap"), running_sums(sizes(g)).alias("before"), hits.alias("hit")))
        made = F.transform(
            both,
            lambda x: F.struct(
                (x["before"] + x["gap"]).alias("start"),
                F.lit(KINDS.index(kind)).alias("kind_no"),
                (x["before"] + x["gap"] + F.length(x["hit"])).alias("end"),
                x["hit"].alias("hit"),
            ),
        )
        return F.filter(made, lambda s: s["hit"].isNotNull())

    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    found = bind(hits, lambda h: F.when(F.size(h) > 0, placed(h)).otherwise(F.array().cast(SPAN)))
    if keep is None:
        return found
    return F.filter(found, lambda s: keep(s["hit"]))


def base_spans(text: Column) -> Column:
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= LEAST_VALUE
    return F.concat(
        spans_of(text, ASSIGN, "assign", value), spans_of(text, ACCESS, "access"), spans_of(text, HEX, "hex")
    )


def upper_tail(z: Column) -> Column:
    """1 - Phi(z), by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(hit: Column) -> Column:
    """encoding, alphabet, length and combined p-value of a candidate."""
    encoding = F.lit(None).cast("string")
    for name, pattern, _ in reversed(ENCODINGS):
        encoding = F.when(F.regexp_like(hit, F.lit(pattern)), F.lit(name)).otherwise(encoding)

    def spelled(x: Column) -> Column:
        letters = F.lit(ENCODINGS[-1][2])
        for name, _, alphabet in ENCODINGS[:-1]:
            letters = F.when(x["encoding"] == name, F.lit(alphabet)).otherwise(letters)
        text = F.translate(F.regexp_replace(x["hit"], "=+$", ""), "-_", "+/")
        text = F.when(x["encoding"] == "hex", F.lower(text)).otherwise(text)
        return F.struct(x["encoding"].alias("encoding"), letters.alias("letters"), text.alias("text"))

    def values(x: Column) -> Column:
        places = F.transform(F.filter(F.split(x["text"], ""), lambda c: c != ""), lambda c: F.instr(x["letters"], c) - 1)
        sizes = [F.length(x["text"]).alias("n"), F.length(x["letters"]).alias("a")]
        return F.struct(*(x[c].alias(c) for c in ("encoding", "letters", "text")), *sizes, places.alias("values"))

    def sums(x: Column) -> Column:
        v, a = x["values"], x["a"]
        squares = F.aggregate(
            F.filter(F.split(x["letters"], ""), lambda c: c != ""),
            F.lit(0.0),
            lambda s, c: s + F.pow(F.lit(0.0) + x["n"] - F.length(F.replace(x["text"], c, F.lit(""))), F.lit(2.0)),
        )
        pairs = F.arrays_zip(
            F.slice(v, F.lit(1), F.size(v) - 1).alias("one"), F.slice(v, F.lit(2), F.size(v) - 1).alias("two")
        )
        return F.struct(
            x["encoding"].alias("encoding"),
            x["n"].cast("double").alias("n"),
            a.cast("double").alias("a"),
            v.alias("values"),
            pairs.alias("pairs"),
            squares.alias("squares"),
            F.aggregate(v, F.lit(0.0), lambda s, c: s + F.when(2 * c >= a, 1.0).otherwise(0.0)).alias("high"),
            (F.aggregate(v, F.lit(0.0), lambda s, c: s + c) / x["n"]).alias("mean"),
        )

    def moments(x: Column) -> Column:
        n, a, high, mean = x["n"], x["a"], x["high"], x["mean"]
        spread = F.aggregate(x["values"], F.lit(0.0), lambda s, c: s + (c - mean) * (c - mean))
        lagged = F.aggregate(x["pairs"], F.lit(0.0), lambda s, p: s + (p["one"] - mean) * (p["two"] - mean))
        changes = F.aggregate(
            x["pairs"], F.lit(1.0), lambda s, p: s + F.when((2 * p["one"] >= a) != (2 * p["two"] >= a), 1.0).otherwise(0.0)
        )
        kept = [x[c].alias(c) for c in ("encoding", "n", "a", "squares")]
        expect = 2 * high * (n - high) / n + 1
        return F.struct(*kept, spread.alias("spread"), lagged.alias("lagged"), changes.alias("changes"), expect.alias("expect"))

    def scores(x: Column) -> Column:
        n, a, expect = x["n"], x["a"], x["expect"]
        chi = a / n * x["squares"] - n
        variance = (expect - 1) * (expect - 2) / (n - 1)
        far = F.lit(12.0)
        return F.struct(
            x["encoding"].alias("encoding"),
            n.alias("n"),
            a.alias("a"),
            ((chi - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)).alias("even"),
            F.when(variance > 0, F.abs((x["changes"] - expect) / F.sqrt(variance))).otherwise(far).alias("runs"),
            F.when(x["spread"] > 0, F.abs((x["lagged"] / x["spread"] + 1 / n) * F.sqrt(n))).otherwise(far).alias("serial"),
        )

    def combined(x: Column) -> Column:
        log = lambda z, sides: -F.log(F.least(F.lit(1.0), F.greatest(F.lit(1e-30), sides * upper_tail(z))))
        half = log(x["even"], 1) + log(x["runs"], 2) + log(x["serial"], 2)
        fisher = bind(half, lambda h: F.least(F.lit(1.0), F.exp(-h) * (1 + h + h * h / 2)))
        return F.struct(
            x["encoding"].alias("encoding"),
            F.floor(F.log2(x["n"])).cast("int").alias("size"),
            F.when(x["n"] >= 2, fisher).otherwise(F.lit(0.0)).alias("p"),
            (x["n"] * F.log2(x["a"])).alias("bits"),
        )

    named = bind(F.struct(encoding.alias("encoding"), hit.alias("hit")), spelled)
    out = bind(named, values)
    for step in (sums, moments, scores, combined):
        out = bind(out, step)
    return out


def candidates(text: Column) -> Column:
    """(start, end, encoding, size, p, bits) of every string that is put to the tests."""
    lettered = lambda hit: F.regexp_like(hit, F.lit("[A-Za-z]"))
    found = spans_of(text, CANDIDATE, "random", lettered)
    made = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["hit"]).alias("t")))
    return F.filter(made, lambda s: s["t"]["bits"] >= BITS)


def thresholds(docs: DataFrame, level: float = LEVEL) -> list[tuple[str, int, float]]:
    """For each encoding and length class the largest p-value at which a string is declared
    not random. The driver gets counts by class and step of p: at most some ten thousand rows."""
    rows = docs.select(F.explode(candidates(F.coalesce("text", F.lit("")))).alias("c"))
    step = F.least(F.lit(STEPS * DEEPEST), F.floor(-F.log10(F.greatest(F.lit(1e-30), F.col("c.t.p"))) * STEPS)).cast("int")
    counts = rows.groupBy("c.t.encoding", "c.t.size", step.alias("step")).count().collect()
    out = []
    for encoding, size in sorted({(r.encoding, r.size) for r in counts}):
        own = {r.step: r["count"] for r in counts if (r.encoding, r.size) == (encoding, size)}
        total, rank, best = sum(own.values()), 0, 0.0
        for step in range(STEPS * DEEPEST, -1, -1):
            rank += own.get(step, 0)
            edge = 10.0 ** (-step / STEPS)
            if own.get(step) and edge <= level * rank / total:
                best = edge
        out.append((encoding, size, best))
    return out


def scan(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256 and spans."""
    limits = thresholds(docs, level)
    text = F.coalesce("text", F.lit(""))

    def random_like(t: Column) -> Column:
        limit = F.lit(0.0)
        for encoding, size, best in limits:
            limit = F.when((t["encoding"] == encoding) & (t["size"] == size), F.lit(best)).otherwise(limit)
        return t["p"] > limit

    def added(base: Column) -> Column:
        free = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        fresh = F.filter(candidates(text), lambda c: random_like(c["t"]) & free(c))
        return F.transform(
            fresh, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind_no"), c["end"].alias("end"))
        )

    slim = F.transform(base_spans(text), lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end")))
    kinds = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"], s["end"])), ","
    )
    results = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    rows = docs.drop(*results).withColumn("_base", F.sort_array(slim))
    rows = rows.withColumn("_all", bind(F.col("_base"), lambda b: F.sort_array(F.concat(b, added(b)))))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind_no"] == k)).cast("long")
    return rows.withColumns(
        {
            "n_assign": count(0),
            "n_access": count(1),
            "n_hex": count(2),
            "base_sha256": F.sha2(shown(F.col("_base")).cast("binary"), 256),
            "spans": shown(F.col("_all")),
        }
    ).drop("_base", "_all")
