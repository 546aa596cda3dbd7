"""Removal of benchmark passages from training text, in DataFrame operations only.

Each benchmark item gives its windows of `width` words (an item of fewer words: one window).
Their distinct n-grams form a hash table that is broadcast; every window of every document is
looked up by hash and confirmed word by word. Tables over `bound` bytes are looked up in
rounds of at most that size each, with the same result.

Defined results
* A-Z lower-cased; words are runs of digits, letters and anything beyond ASCII. Null text or
  item text: no word, no window.
* Null item_id: its windows hit, but it isn't listed. Items of one id count once.
* Rows of one doc_id and text get the same result; every row stays one row.
* Empty documents or benchmark: no hit. Extra columns stay, whatever their names; those named like
  results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import bind, indexes, lower_ascii, written

WIDTH = 10
BOUND = 32 << 20
#: What a broadcast key of a row takes in memory, at most.
KEY_BYTES = 128
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_OF_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")


def words_of(text: Column) -> Column:
    """The words of a text, in the case they are written in."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NO_WORD), lambda w: w != "")


def word_codes(words: Column) -> Column:
    """A hash of each word; the words must be in lower case."""
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hashes(codes: Column, width: Column | int) -> Column:
    """Hashes of all windows of so many words, from the codes of the words: no letter is read once a window."""
    size = F.lit(width) if isinstance(width, int) else width
    return F.transform(indexes(1, F.size(codes) - size + 1), lambda i: F.xxhash64(F.slice(codes, i, size)))


def folded(text: Column) -> Column:
    """Full lower case, with one small sigma: which of the two `lower` takes depends on what follows."""
    return F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3"))


def lowered(words: Column) -> Column:
    """The words with A-Z, and nothing else, in lower case: what is compared in the end."""
    return F.transform(words, lower_ascii)


def benchmark_grams(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """hash, gram (its words), width, and the ids of the items it comes from, as strings."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    rows = rows.filter(F.size("words") > 0).withColumn("width", F.least(F.size("words"), F.lit(width)))
    starts = F.explode(indexes(1, F.size("words") - F.col("width") + 1))
    rows = rows.select("item", "width", "words", starts.alias("at"))
    cut = F.slice("words", F.col("at"), F.col("width"))
    rows = rows.select("item", "width", lowered(cut).alias("gram"))
    hashed = F.xxhash64(word_codes(F.transform("gram", folded))).alias("hash")
    return rows.select("*", hashed).groupBy("hash", "gram", "width").agg(F.collect_set("item").alias("items"))


def row_key() -> Column:
    text = F.coalesce("text", F.lit(""))
    return F.unhex(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), text).cast("binary"), 256))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, bound: int = BOUND) -> DataFrame:
    """For each text with hits: its key, the spans (first word, words) hit, and the items."""
    grams = written(benchmark_grams(benchmark, width), "benchmark-grams")
    letters = F.length(F.concat_ws("", "gram")) + F.length(F.concat_ws("", "items"))
    weight = letters * 4 + 24 * (F.size("gram") + F.size("items")) + 100
    facts = grams.agg(F.sum(weight).alias("bytes"), F.collect_set("width").alias("widths")).first()
    rounds = -(-(facts["bytes"] or 0) // bound)
    text = F.coalesce("text", F.lit(""))
    low = F.filter(F.split(folded(text), NO_WORD), lambda w: w != "")
    widths = sorted(facts["widths"], reverse=True)
    rows = docs.select(row_key().alias("key"), text.alias("text"), low.alias("low"))
    found = None
    for k in range(rounds):
        part = grams.filter(F.pmod(F.col("hash"), F.lit(rounds)) == k)
        hashes = bind(word_codes(F.col("low")), lambda c: F.concat(*(window_hashes(c, n) for n in widths)))
        seen = rows.select("key", "text", F.size("low").alias("n"), F.posexplode(hashes).alias("place", "seen"))
        # Hashes of full lower case find candidates; the words as written decide.
        hits = seen.join(F.broadcast(part), F.col("seen") == F.col("hash"))
        at = F.col("place")
        before = F.lit(0)
        for n in widths:
            at = F.when(F.col("width") == n, F.col("place") - before + 1).otherwise(at)
            before = before + F.greatest(F.lit(0), F.col("n") - n + 1)
        hits = hits.withColumn("at", at).filter("at between 1 and n - width + 1")
        hits = hits.filter(lowered(F.slice(words_of(F.col("text")), F.col("at"), F.col("width"))) == F.col("gram"))
        hits = hits.select("key", F.struct("at", F.col("width").alias("span")).alias("span"), "items")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        kinds = "key binary, span struct<at:int,span:int>, items array<string>"
        found = docs.sparkSession.createDataFrame([], kinds)
    # A text's own windows meet here, at most as many as it has words.
    return found.groupBy("key").agg(
        F.sort_array(F.collect_set("span")).alias("hit_spans"), F.collect_set("items").alias("item_lists")
    )


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def add(a: Column, s: Column) -> Column:
        end = s["at"] + s["span"]
        fresh = F.greatest(F.lit(0), end - F.greatest(s["at"], a["end"]))
        return F.struct(F.greatest(end, a["end"]).alias("end"), (a["total"] + fresh).alias("total"))

    return F.aggregate(spans, start, add, lambda a: a["total"])


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, bound: int = BOUND) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans."""
    hits = benchmark_hits(docs, benchmark, width, bound)
    items = F.sort_array(F.array_distinct(F.flatten("item_lists")))
    hits = hits.select("key", "hit_spans", covered(F.col("hit_spans")).alias("n_hit"), items.alias("items"))
    # The documents' own columns stay in a struct, whatever their names, until all others are gone.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in RESULTS)).alias("row")
    rows = docs.select(row, row_key().alias("row_key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    rows = rows.join(hits, F.col("row_key") == F.col("key"), "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "row.*",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        "hit_spans",
    )


def without_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, bound: int = BOUND) -> DataFrame:
    """The documents that hold no benchmark window."""
    hits = written(benchmark_hits(docs, benchmark, width, bound).select("key"), "contaminated")
    # Few texts hold benchmark passages; their keys are counted before they may be broadcast.
    if hits.count() * KEY_BYTES <= bound:
        hits = F.broadcast(hits)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key().alias("row_key"))
    return rows.join(hits, F.col("row_key") == F.col("key"), "left_anti").select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, bound: int = BOUND) -> DataFrame:
    """All documents, without the words that hit; what stands between words stays."""
    found = scan(docs, benchmark, width, bound)
    text = F.col("text")
    words = F.regexp_extract_all(text, F.lit(WORD_OF_ANY_CASE), 0)
    gaps = F.split(text, WORD_OF_ANY_CASE, -1)

    def inside(i: Column) -> Column:
        return F.exists("hit_spans", lambda s: (s["at"] <= i + 1) & (i + 1 < s["at"] + s["span"]))

    def rebuilt(gap: Column) -> Column:
        kept = F.transform(words, lambda w, i: F.concat(F.when(inside(i), "").otherwise(w), F.get(gap, i + 1)))
        return F.concat(F.get(gap, F.lit(0)), F.array_join(kept, ""))

    cleaned = F.when(F.col("contaminated"), bind(gaps, rebuilt)).otherwise(text)
    return found.withColumn("text", cleaned).select(*docs.columns)
