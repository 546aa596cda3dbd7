"""Mixing of sources to target weights over fixed-length blocks of words.

Each source is a line of words: its documents in a fixed order, cut into blocks of BLOCK words.
Each source gets as many slots as its target needs. The slots are dealt to output shards of
SHARD slots by multinomial draws that are conditional on these totals: the shards are the leaves
of a binary tree, and each node splits its sources' counts between its halves with a binomial draw
for each source, seeded by the node; what the draws miss of a half's size is spread over the
sources in proportion to what they have. So each shard finds its counts, and how many slots its
sources had before it, alone, in the same way at every size. A source's n-th slot is mapped to a block by a
pseudorandom permutation of the source's blocks, one permutation for each pass over the source,
and slots meet blocks in a join on (source, block). The last slot of a source is cut to the words
that its target still lacks.

Defined results
* Words are runs of anything but ASCII blanks; null text: no word. Documents without words are
  never taken. Null sources are one source, last in order.
* Rows of one doc_id stay apart: ties in order are broken by a hash of the text; equal rows share
  what falls on them in any order.
* Empty table: no row. All texts empty: targets 0. Extra columns stay in `mixed_documents`.
* The number of sources must fit the driver (a mixture lists them); documents and blocks needn't.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm.common import WHITESPACE, written

#: Fixed values of the task: weights in turn, the share of all words to take, most passes.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 128
SHARD = 1024
#: Parts that a source is cut into for its order; more if a part would get over BUCKET_ROWS rows.
BUCKETS, BUCKET_ROWS = 1024, 100_000
SEED = 17
SLOT = "shard long, place int, source_no int, pass int, block long, words int"


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take from each source; what is above `most` times a source is shared anew."""
    left, out = set(range(len(sizes))), [0.0] * len(sizes)
    rest = share * sum(sizes)
    while left:
        scale = rest / sum(weights[i % len(weights)] for i in left)
        full = {i for i in left if weights[i % len(weights)] * scale > most * sizes[i]}
        if not full:
            for i in left:
                out[i] = weights[i % len(weights)] * scale
            break
        for i in full:
            out[i] = most * sizes[i]
            rest -= out[i]
        left -= full
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """One row a document, without its text: its source, size and first word in its source.

    The order within a source is (bucket, doc_id, hash of the text); running sums go over the
    rows of one bucket, then over the buckets of one source, so a source's rows never meet.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.size(F.filter(F.split(text, WHITESPACE), lambda w: w != "")).cast("long")
    buckets = max(BUCKETS, 1 << (docs.count() // BUCKET_ROWS).bit_length())
    rows = docs.select(
        "doc_id", "source", size.alias("size"), F.xxhash64(text).alias("text_hash")
    ).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)).cast("int"))
    rows = rows.withColumn("has_source", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))
    keys = ["has_source", "source", "bucket"]
    inside = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("doc_id"), "text_hash")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"rank": F.row_number().over(inside), "in_bucket": before})
    return written(rows, "ledger")


class Permutation:
    """A pseudorandom permutation of range(n): four Feistel rounds, walked until inside."""

    def __init__(self, n: int, *key: int) -> None:
        self.n = max(1, n)
        self.half = max(1, (max(1, self.n - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = np.random.default_rng([SEED, *key]).integers(1, 1 << 62, 4, dtype=np.uint64)

    def _round(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in self.keys:
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (mixed >> np.uint64(33)) & self.mask
        return left << np.uint64(self.half) | right

    def __call__(self, places: np.ndarray) -> np.ndarray:
        x = self._round(places.astype(np.uint64))
        while (out := x >= self.n).any():
            x[out] = self._round(x[out])
        return x.astype(np.int64)

    def place_of(self, block: int) -> int:
        """Where the permutation puts `block`: found by walking the inverse rounds."""
        x = block
        while True:
            left, right = x >> self.half, x & int(self.mask)
            for key in reversed(self.keys):
                mixed = (int(left) + int(key)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
                mixed ^= mixed >> 29
                mixed = mixed * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
                left, right = right ^ (mixed >> 33) & int(self.mask), left
            x = left << self.half | right
            if x < self.n:
                return int(x)


def slots_of(size: int, words: int, source: int) -> tuple[int, int]:
    """Number of slots, and words of the last one, so that the slots hold `words` words."""
    if not size or not words:
        return 0, 0
    blocks, tail = -(-size // BLOCK), size - (-(-size // BLOCK) - 1) * BLOCK
    passes, rest = divmod(words, size)
    if not rest:
        return passes * blocks, 0
    short = Permutation(blocks, source, passes).place_of(blocks - 1)
    slots = -(-rest // BLOCK)
    if short < slots:
        slots = max(short + 1, -(-(rest - tail) // BLOCK) + 1)
        if slots == short + 1:
            return passes * blocks + slots, rest - (slots - 1) * BLOCK
        return passes * blocks + slots, rest - (slots - 2) * BLOCK - tail
    return passes * blocks + slots, rest - (slots - 1) * BLOCK


def halved(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's slots fall to a half of `n` slots: binomial draws, corrected to n."""
    size = int(counts.sum())
    left = rng.binomial(counts, n / size if size else 0.0)
    lack = n - int(left.sum())
    # Sources give or take of what they have left, in proportion; products may pass 64 bits.
    room = [int(v) for v in (counts - left if lack > 0 else left)]
    total, lack, sign = sum(room), abs(lack), 1 if lack > 0 else -1
    if lack:
        share = [v * lack // total for v in room]
        rest = lack - sum(share)
        for i in sorted(range(len(room)), key=lambda i: (-(room[i] * lack % total), i))[:rest]:
            share[i] += 1
        left = left + sign * np.array(share, np.int64)
    return left


def shard_counts(totals: np.ndarray, shards: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in the shard, and in all shards before it."""
    all_slots = int(totals.sum())
    low, high, counts, before = 0, shards, totals.copy(), np.zeros_like(totals)
    while high - low > 1:
        middle = (low + high) // 2
        n = min(all_slots, middle * SHARD) - min(all_slots, low * SHARD)
        left = halved(counts, n, np.random.default_rng([SEED, low, high]))
        if shard < middle:
            high, counts = middle, left
        else:
            low, counts, before = middle, counts - left, before + left
    return counts, before


def slots(spark, totals: list[int], blocks: list[int], last_words: list[int]) -> DataFrame:
    """The slots of all shards: which block of which source stands at which place."""
    numbers = np.array(totals, np.int64)
    shards = -(-int(numbers.sum()) // SHARD)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], Permutation] = {}
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts, before = shard_counts(numbers, shards, shard)
                parts = []
                for source in np.flatnonzero(counts).tolist():
                    nth = before[source] + np.arange(counts[source])
                    turn = nth // blocks[source]
                    for one in np.unique(turn).tolist():
                        order = known.setdefault((source, one), Permutation(blocks[source], source, one))
                        at = nth[turn == one]
                        words = np.full(len(at), BLOCK)
                        if last_words[source]:
                            words[at == totals[source] - 1] = last_words[source]
                        chosen = order(at - one * blocks[source])
                        parts.append(np.column_stack([np.full(len(at), source), np.full(len(at), one), chosen, words]))
                rows = np.concatenate(parts)
                rows = rows[np.random.default_rng([SEED, 1, shard]).permutation(len(rows))]
                columns = [np.full(len(rows), shard), np.arange(len(rows), dtype=np.int32), rows[:, 0].astype(np.int32)]
                columns += [rows[:, 1].astype(np.int32), rows[:, 2], rows[:, 3].astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    list(map(pa.array, columns)), ["shard", "place", "source_no", "pass", "block", "words"]
                )

    tasks = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(0, shards, 1, tasks).mapInArrow(draw, SLOT)


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, spans): the documents' ledger with source_no, source_size, target and first word;
    and for every slot the words [from, to) of each document (source_no, bucket, rank) in it."""
    spark = docs.sparkSession
    rows = ledger(docs)
    keys = ["has_source", "source"]
    buckets = rows.groupBy(*keys, "bucket").agg(F.sum("size").alias("bucket_size"))
    # One row for each bucket of a source meets here.
    order = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("bucket_first", F.coalesce(F.sum("bucket_size").over(order), F.lit(0)))
    sources = rows.groupBy(*keys).agg(F.sum("size").alias("size")).collect()
    sources.sort(key=lambda r: (not r.has_source, r.source))
    sizes = [r["size"] for r in sources]
    wanted = targets(sizes)
    plan = [slots_of(n, min(round(t), int(MOST * n)), i) for i, (n, t) in enumerate(zip(sizes, wanted))]
    listed = [(r.has_source, r.source, i, sizes[i], wanted[i]) for i, r in enumerate(sources)]
    names = spark.createDataFrame(
        listed, "has_source boolean, source string, source_no int, source_size long, target double"
    )
    buckets = buckets.join(F.broadcast(names), keys).drop("bucket_size")
    # One row for each bucket of a source.
    placed = rows.join(buckets, [*keys, "bucket"]).withColumn("first", F.col("bucket_first") + F.col("in_bucket"))
    placed = written(placed.drop("in_bucket", "bucket_first"), "placed")
    taken = slots(spark, [p[0] for p in plan], [-(-n // BLOCK) for n in sizes], [p[1] for p in plan])
    length = F.lit(BLOCK)
    pieces = placed.filter("size > 0").select(
        F.col("source_no").alias("of_source"),
        "bucket",
        "rank",
        "first",
        "size",
        F.explode(
            F.sequence(F.floor(F.col("first") / length), F.floor((F.col("first") + F.col("size") - 1) / length))
        ).alias("of_block"),
    )
    # The size of generated slots is unknown to the planner, which would broadcast them.
    met = taken.hint("merge").join(pieces, (F.col("source_no") == F.col("of_source")) & (F.col("block") == F.col("of_block")))
    start, end = F.col("block") * length, F.col("block") * length + F.col("words")
    met = met.withColumns(
        {
            "from": F.greatest(F.col("first"), start) - F.col("first"),
            "to": F.least(F.col("first") + F.col("size"), end) - F.col("first"),
        }
    ).filter(F.col("from") < F.col("to"))
    return placed, met.select("shard", "place", "source_no", "pass", "block", "bucket", "rank", "from", "to")


DOCUMENT = ["source_no", "bucket", "rank"]


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row."""
    placed, spans = mix(docs)
    taken = spans.groupBy(*DOCUMENT).agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    rows = placed.join(taken, DOCUMENT, "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


@F.pandas_udf(T.StringType())
def cut_words(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Of each text the words in the sorted spans, with what stands between neighbours."""

    def cut(text: str, own) -> str:
        ends = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        merged: list[list[int]] = []
        for s in own:
            if merged and merged[-1][1] >= s["from"]:
                merged[-1][1] = max(merged[-1][1], s["to"])
            else:
                merged.append([s["from"], s["to"]])
        if merged == [[0, len(ends)]]:
            return text
        return "\n".join(text[ends[a][0] : ends[b - 1][1]] for a, b in merged)

    return pd.Series([cut(t, s) for t, s in zip(texts, spans)])


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each pass that takes words of a document, with the words
    taken (the whole text as it is, if all of them), and n_chars where the table has it."""
    placed, spans = mix(docs)
    own = spans.groupBy(*DOCUMENT, "pass").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("_spans"))
    named = own.join(placed.select(*DOCUMENT, "doc_id", "source", "has_source", "text_hash"), DOCUMENT)
    return texts_of(docs, named, "_spans", cut_words("text", "spans"))


def texts_of(docs: DataFrame, named: DataFrame, spans: str, text: Column) -> DataFrame:
    """The documents' columns for each row of `named`, with `text` made of their text and the spans."""
    named = named.select(
        "doc_id",
        "text_hash",
        F.when(F.col("has_source"), F.col("source")).alias("source"),
        F.col(spans).alias("spans"),
        # Equal rows are told apart by their order, so each gets the spans of one.
        F.dense_rank().over(Window.partitionBy("doc_id", "text_hash", "has_source", "source").orderBy("rank")).alias("nth"),
    )
    # The documents' columns stay in a struct, whatever their names.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.withColumn("row_hash", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    nth = Window.partitionBy("row.doc_id", "row_hash", "row.source").orderBy("row.doc_id")
    rows = rows.withColumn("row_nth", F.row_number().over(nth))
    same = (
        F.col("row.doc_id").eqNullSafe(F.col("doc_id"))
        & (F.col("row_hash") == F.col("text_hash"))
        & F.col("row.source").eqNullSafe(F.col("source"))
        & (F.col("row_nth") == F.col("nth"))
    )
    met = rows.join(named, same).select("row", F.col("row.text").alias("text"), "spans")
    met = met.select("row", text.alias("mixed"))
    changed = {"text": F.col("mixed")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("mixed").cast(docs.schema["n_chars"].dataType)
    return met.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


@F.pandas_udf(T.ArrayType(T.StringType()))
def cut_pieces(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """The words of each span of a text, joined by single spaces."""

    def cut(text: str, own) -> list[str]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return [" ".join(words[s["from"] : s["to"]]) for s in own]

    return pd.Series([cut(t, s) for t, s in zip(texts, spans)])


def packed_blocks(docs: DataFrame) -> DataFrame:
    """The mix itself, a row for each slot: shard, place, source, pass, block, n_words and text.

    A slot holds BLOCK words (the last of a source maybe fewer), of the documents that its block
    of the source runs through, in order.
    """
    placed, spans = mix(docs)
    slot = ["shard", "place", "pass", "block"]
    own = spans.groupBy(*DOCUMENT).agg(F.collect_list(F.struct(*slot, "from", "to")).alias("spans"))
    keys = placed.select(*DOCUMENT, "doc_id", "source", "has_source", "text_hash", "first")
    own = own.join(keys, DOCUMENT).withColumn("source", F.when(F.col("has_source"), F.col("source")))
    texts = docs.select("doc_id", "source", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    texts = texts.dropDuplicates(["doc_id", "source", "text_hash"]).select(*(F.col(c).alias(f"t_{c}") for c in texts.columns))
    same = (
        F.col("doc_id").eqNullSafe(F.col("t_doc_id"))
        & (F.col("text_hash") == F.col("t_text_hash"))
        & F.col("source").eqNullSafe(F.col("t_source"))
    )
    met = own.join(texts, same).withColumn("cut", cut_pieces("t_text", "spans"))
    met = met.select("source", "first", F.inline(F.arrays_zip("spans", "cut")))
    met = met.select("source", "spans.*", F.struct((F.col("first") + F.col("spans.from")).alias("at"), "cut", (F.col("spans.to") - F.col("spans.from")).alias("n")).alias("part"))
    # The parts of one slot: BLOCK words at most.
    slots_ = met.groupBy(*slot, "source").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    words = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    return slots_.select("shard", "place", "source", "pass", "block", words.alias("n_words"), F.array_join("parts.cut", " ").alias("text"))
