"""Stored search: BM25 from posting blocks with score bounds, kept up by difference.

Documents are numbered in key order and cut into ranges of RANGE_DOCS. A block holds the postings
of one token in one range, with the largest term count and the least length in it, which bound
what the block can add to any score. A question reads the headers of its tokens' blocks, sums
the bounds by range, scores the most promising ranges, takes the k-th best score as a threshold
and opens only ranges whose bound reaches it; the others cannot hold a document of the answer, so
the answer is that of a full scan. No text is read.

The index is a store of segments. An update compares a fingerprint of each document with the
stored one, tokenizes changed documents only, and writes them as a segment with the keys that it
replaces. Document frequencies are kept as signed changes, taken from the stored terms of replaced
documents, and the statistics of each kind are written with every commit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline import settings
from treeline.functions.tokens import mixed_pieces
from treeline.operators.distributed import first_per_key
from treeline.operators.retrieval import KINDS, _raw_idf
from treeline.sources.segments import GONE, Segments, open_store

KEY = ["kind", "doc_id"]
BLOCK = ["token", "kind", "range"]
RANGE_BITS = 6
RANGE_DOCS = 1 << RANGE_BITS
#: Bounds and scores are sums in different orders; a bound counts as this much larger.
SLACK = 1 + 1e-9


def fingerprints(corpus: DataFrame) -> DataFrame:
    """kind, doc_id and a fingerprint of all parts of each document."""
    content = [c for c in ("module_path", "part", "text") if c in corpus.columns]
    row = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content))
    return corpus.groupBy(*KEY).agg(F.struct(F.count(F.lit(1)).alias("parts"), F.bit_xor(row).alias("xor"), F.max(row).alias("max")).alias("print"))


def placed_rows(corpus: DataFrame, docs: DataFrame) -> DataFrame:
    """The corpus with the range of each document; texts meet by document, so that their terms need no shuffle."""
    # A fixed number of parts: those of a few MB of text hold many terms, which adaptive execution cannot see.
    parts = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), corpus.rdd.getNumPartitions())
    return corpus.repartition(parts, *KEY).join(docs.select(*KEY, "range").hint("shuffle_hash"), KEY, "left")


def term_rows(corpus: DataFrame) -> DataFrame:
    """kind, doc_id, token, tf; and range, if the corpus has it."""
    own = [*KEY, *(c for c in ("range",) if c in corpus.columns)]
    pieces = corpus.select(*own, F.explode(F.transform(mixed_pieces(F.col("text")), F.lower)).alias("token"))
    return pieces.groupBy(*own, "token").agg(F.count(F.lit(1)).alias("tf"))


def block_rows(terms: DataFrame) -> DataFrame:
    """Posting blocks of terms with range and dl, in order; a block has RANGE_DOCS entries at most.

    Terms are dealt by ranges of tokens, as the blocks are to lie, and form their blocks there.
    """
    entry = F.struct("doc_id", F.col("tf"), F.col("dl"))
    rows = terms.filter("doc_id IS NOT NULL").select("token", "kind", "range", "doc_id", "tf", "dl")
    return rows.repartitionByRange(*BLOCK).groupBy(*BLOCK).agg(
        F.count(F.lit(1)).alias("df"),
        F.max("tf").alias("max_tf"),
        F.min("dl").alias("min_dl"),
        F.sort_array(F.collect_list(entry)).alias("entries"),
    ).sortWithinPartitions(*BLOCK)


def kind_statistics(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row a kind: documents, tokens and the mean inverse document frequency of its vocabulary."""
    totals = docs.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("tokens"))
    # Vocabulary by document frequency first: few rows, whatever the number of tokens.
    grouped = vocabulary.groupBy("kind", "df").agg(F.count(F.lit(1)).alias("words")).join(F.broadcast(totals.select("kind", "n")), "kind")
    mean = grouped.groupBy("kind").agg(
        (F.sum(F.col("words") * _raw_idf(F.col("n"), F.col("df"))) / F.sum("words")).alias("mean_idf")
    )
    return totals.join(mean, "kind", "left")


def merged_vocabulary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("kind", "token").agg(F.sum("df").alias("df")).filter("df > 0")


@dataclass
class RankedIndex:
    """An index at one version of its store."""

    store: Segments

    def documents(self) -> DataFrame:
        return self.store.read("docs")

    def vocabulary(self) -> DataFrame:
        """kind, token and document frequency."""
        return merged_vocabulary(self.store.read("vocabulary", merged=False))

    def postings(self) -> DataFrame:
        """kind, token, doc_id, tf and dl of every document that counts."""
        rows = self.store.read("blocks", merged=False).select("segment", "kind", "token", F.inline("entries"))
        return self._counting(rows).select("kind", "token", "doc_id", "tf", "dl")

    def _counting(self, rows: DataFrame) -> DataFrame:
        removed = self.store.removed()
        return rows if removed is None else self.store.without(rows, removed)

    def weights(self, query_tokens: list[str]) -> DataFrame:
        """kind, token, w (inverse document frequency times occurrences in the question), avgdl."""
        spark, terms = self.store.spark, list(dict.fromkeys(query_tokens))
        times = spark.createDataFrame([(t, query_tokens.count(t)) for t in terms], "token string, times int")
        stats = self.store.last("stats").withColumn("avgdl", F.try_divide("tokens", "n"))
        changes = self.store.read("vocabulary", merged=False).filter(F.col("token").isin(terms))
        # One row for each kind, and for each token of the question.
        rows = merged_vocabulary(changes).join(F.broadcast(stats), "kind").join(F.broadcast(times), "token")
        raw = _raw_idf(F.col("n"), F.col("df"))
        idf = F.when(raw < 0, settings.BM25_EPSILON * F.col("mean_idf")).otherwise(raw)
        return rows.select("kind", "token", (F.col("times") * idf).alias("w"), "avgdl")

    def _scores(self, blocks: DataFrame, weights: DataFrame) -> DataFrame:
        rows = blocks.join(F.broadcast(weights), ["kind", "token"])
        rows = self._counting(rows.select("segment", "kind", "w", "avgdl", F.inline("entries")))
        return rows.groupBy(*KEY).agg(F.sum(contribution("tf", "dl")).alias("score"))

    def opened(self, query_tokens: list[str], k: int = settings.PER_SIDE) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(weights, blocks of the question's tokens, ranges to open): kind, segment, range, bound, opened."""
        weights = self.weights(query_tokens)
        listed = weights.collect()
        weights = self.store.spark.createDataFrame(listed, weights.schema)
        blocks = self.store.read("blocks", merged=False).filter(F.col("token").isin(list(set(query_tokens))))
        headers = blocks.select("segment", "kind", "token", "range", "max_tf", "min_dl").join(F.broadcast(weights), ["kind", "token"])
        place = ["kind", "segment", "range"]
        ranges = headers.groupBy(*place).agg(F.sum(contribution("max_tf", "min_dl")).alias("bound"), F.count(F.lit(1)).alias("blocks"))
        if any(r.w < 0 for r in listed):
            # Scores may fall by a posting, so bounds say nothing; every range is opened.
            return weights, blocks, ranges.withColumn("opened", F.lit(True))
        best = first_per_key(ranges, ["kind"], [F.desc("bound"), F.asc("segment"), F.asc("range")], k).select(*place)
        # At most k ranges of each kind.
        first = self._scores(blocks.join(F.broadcast(best), place, "left_semi"), weights)
        least = first_per_key(first, ["kind"], [F.desc("score"), F.asc("doc_id")], k).filter(F.col("rank") == k)
        least = least.select("kind", F.col("score").alias("least"))
        # One row a kind.
        marked = ranges.join(F.broadcast(least), "kind", "left")
        return weights, blocks, marked.withColumn(
            "opened", F.col("least").isNull() | (F.col("bound") * SLACK >= F.col("least"))
        ).drop("least")

    def bm25(self, query_tokens: list[str], k: int = settings.PER_SIDE) -> DataFrame:
        """Top k documents of each kind with a positive score: kind, doc_id, score, rank."""
        weights, blocks, ranges = self.opened(query_tokens, k)
        chosen = ranges.filter("opened").select("kind", "segment", "range")
        scored = self._scores(blocks.join(chosen, ["kind", "segment", "range"], "left_semi"), weights)
        return first_per_key(scored, ["kind"], [F.desc("score"), F.asc("doc_id")], k).filter("score > 0")

    def block_report(self, query_tokens: list[str], k: int = settings.PER_SIDE) -> DataFrame:
        """kind, blocks of the question's tokens, and how many of them were opened and skipped."""
        _, _, ranges = self.opened(query_tokens, k)
        opened = F.coalesce(F.sum(F.when(F.col("opened"), F.col("blocks"))), F.lit(0))
        rows = ranges.groupBy("kind").agg(F.sum("blocks").alias("blocks"), opened.alias("opened"))
        return rows.withColumn("skipped", F.col("blocks") - F.col("opened"))

    def update(self, corpus: DataFrame) -> RankedIndex:
        """The index of this corpus: what differs becomes a new segment; nothing is written if nothing does."""
        rows = corpus.filter(F.col("kind").isin(*KINDS))
        prints = fingerprints(rows)
        if not self.store.segments:
            return self._add(rows, prints, None)
        old = self.documents().select(*KEY, F.col("print").alias("old"))
        differing = prints.join(old, KEY, "full_outer").filter(~F.col("print").eqNullSafe(F.col("old")))
        draft = self.store.draft()
        differing = draft.put("changes", differing)
        if differing.isEmpty():
            return self
        fresh = differing.filter("print IS NOT NULL").select(*KEY, "print")
        return self._add(rows.join(fresh, KEY, "left_semi"), fresh, differing.filter("old IS NOT NULL").select(*KEY), draft)

    def _add(self, rows: DataFrame, prints: DataFrame, gone: DataFrame | None, draft=None) -> RankedIndex:
        draft = draft or self.store.draft()
        prints = self._numbered(draft, "numbers", prints)
        # Lengths come from a document's terms, which lie together.
        length = F.sum("tf").over(W.partitionBy(*KEY))
        terms = draft.put("terms", term_rows(placed_rows(rows, prints)).withColumn("dl", length))
        changes = terms.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("df"))
        docs = draft.put("docs", self._measured(prints, terms))
        every = docs
        if gone is not None:
            gone = draft.put(GONE, gone)
            lost = self.store.read("terms").join(gone.hint("shuffle_hash"), KEY, "left_semi").groupBy("kind", "token").agg((-F.count(F.lit(1))).alias("df"))
            changes = merged_changes(changes.unionByName(lost))
            every = docs.unionByName(self.documents().join(gone, KEY, "left_anti"))
        draft.put("blocks", block_rows(terms))
        changes = draft.put("vocabulary", changes, "token", "kind")
        known = changes if gone is None else changes.unionByName(self.store.read("vocabulary", merged=False).drop("segment"))
        draft.put("stats", kind_statistics(every, merged_vocabulary(known)))
        return RankedIndex(draft.commit())

    def _numbered(self, draft, name: str, docs: DataFrame) -> DataFrame:
        """Documents with their range, written; ranges follow the order of keys, for alike documents."""
        docs = docs.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
        number = F.shiftright(F.monotonically_increasing_id(), RANGE_BITS)
        return draft.put(name, docs.withColumn("range", number))

    def _measured(self, prints: DataFrame, terms: DataFrame) -> DataFrame:
        """Documents with their length."""
        lengths = terms.groupBy(*KEY).agg(F.sum("tf").alias("dl"))
        docs = prints.join(lengths, KEY, "left").withColumn("dl", F.coalesce("dl", F.lit(0).cast("long")))
        return docs.select(*KEY, "print", "dl", "range")

    def compacted(self) -> RankedIndex:
        """The same index in one segment, made from stored terms; no text is read."""
        draft = self.store.draft()
        old = self.documents().select(*KEY, "print", "dl")
        docs = self._numbered(draft, "docs", old)
        stored = self.store.read("terms").select(*KEY, "token", "tf")
        terms = draft.put("terms", stored.join(docs.select(*KEY, "range", "dl").hint("shuffle_hash"), KEY, "left"))
        draft.put("blocks", block_rows(terms))
        words = draft.put("vocabulary", terms.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("df")), "token", "kind")
        draft.put("stats", kind_statistics(docs, words))
        return RankedIndex(draft.commit(replace_all=True))


def contribution(tf: str, dl: str) -> Column:
    norm = settings.BM25_K1 * (
        1 - settings.BM25_B + settings.BM25_B * F.coalesce(F.try_divide(F.col(dl), F.col("avgdl")), F.lit(0.0))
    )
    return F.col("w") * (F.col(tf) * (settings.BM25_K1 + 1) / (F.col(tf) + norm))


def merged_changes(changes: DataFrame) -> DataFrame:
    return changes.groupBy("kind", "token").agg(F.sum("df").alias("df")).filter("df <> 0")


def open_index(spark: SparkSession, folder: str) -> RankedIndex | None:
    """The stored index, or None if there is none."""
    store = open_store(spark, folder, KEY)
    return RankedIndex(store) if store else None


def refreshed_index(corpus: DataFrame, folder: str) -> RankedIndex:
    """The stored index brought up to the corpus, or a new one."""
    return RankedIndex(Segments(corpus.sparkSession, folder, KEY)).update(corpus)
