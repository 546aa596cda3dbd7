"""A search index kept as tables, reused while its signature still fits.

Layout below one folder: `doc_len`, `postings` (sorted by token, so a query reads
only the row groups of its terms), `vocabulary` and `signature`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline import settings
from treeline.functions.tokens import mixed_pieces
from treeline.operators.distributed import first_per_key
from treeline.operators.retrieval import KINDS, _raw_idf
from treeline.operators.snapshot import signature

LAYOUT = "split_by_kind"


@dataclass
class SearchIndex:
    """Term statistics of a corpus, split by kind."""

    doc_len: DataFrame
    postings: DataFrame
    vocabulary: DataFrame

    def bm25(self, query_tokens: list[str], k: int = settings.PER_SIDE) -> DataFrame:
        """Top documents per kind by BM25; reads the postings of the query's terms only."""
        weights = self.postings.sparkSession.createDataFrame(
            [(t, query_tokens.count(t)) for t in dict.fromkeys(query_tokens)], "token string, times int"
        )
        # One row per kind.
        totals = self.doc_len.groupBy("kind").agg(
            F.count(F.lit(1)).alias("n"), F.try_divide(F.sum("dl"), F.count(F.lit(1))).alias("avgdl")
        )
        least = (
            self.vocabulary.join(F.broadcast(totals), "kind").groupBy("kind")
            .agg((settings.BM25_EPSILON * F.avg(_raw_idf(F.col("n"), F.col("df")))).alias("least"))
        )
        # At most kinds x query terms rows.
        idf = (
            self.vocabulary.filter(F.col("token").isin(*set(query_tokens)))
            .join(F.broadcast(totals), "kind").join(F.broadcast(least), "kind")
            .join(F.broadcast(weights), "token")
            .select(
                "kind", "token", "avgdl",
                (F.col("times") * F.when(_raw_idf(F.col("n"), F.col("df")) < 0, F.col("least"))
                 .otherwise(_raw_idf(F.col("n"), F.col("df")))).alias("w"),
            )
        )
        norm = settings.BM25_K1 * (1 - settings.BM25_B + settings.BM25_B * F.col("dl") / F.col("avgdl"))
        scored = (
            self.postings.filter(F.col("token").isin(*set(query_tokens)))
            .join(F.broadcast(idf), ["kind", "token"])
            .groupBy("kind", "doc_id")
            .agg(F.sum(F.col("w") * F.col("tf") * (settings.BM25_K1 + 1) / (F.col("tf") + norm)).alias("score"))
        )
        ranked = first_per_key(scored, ["kind"], [F.col("score").desc(), F.col("doc_id").asc()], k)
        return ranked.filter("score > 0")


def build_index(corpus: DataFrame) -> SearchIndex:
    """Index of corpus rows (kind, doc_id, text); parts of one document are counted together."""
    docs = corpus.filter(F.col("kind").isin(*KINDS))
    lengths = docs.groupBy("kind", "doc_id").agg(F.sum(F.size(mixed_pieces(F.col("text")))).alias("dl"))
    tf = (
        docs.select("kind", "doc_id", F.explode(mixed_pieces(F.col("text"))).alias("piece"))
        .groupBy("kind", F.lower("piece").alias("token"), "doc_id")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    postings = tf.join(lengths, ["kind", "doc_id"])
    vocabulary = tf.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("df"))
    return SearchIndex(lengths, postings, vocabulary)


def save_index(corpus: DataFrame, folder: str) -> None:
    """Write the index tables; the postings are written once and the vocabulary comes from them."""
    spark = corpus.sparkSession
    index = build_index(corpus)
    index.doc_len.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/doc_len")
    (
        index.postings.repartitionByRange("token", "doc_id").sortWithinPartitions("token", "doc_id")
        .write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/postings")
    )
    written = spark.read.parquet(f"{folder}/postings")
    written.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(
        f"{folder}/vocabulary"
    )
    signature(corpus, LAYOUT).write.mode("overwrite").parquet(f"{folder}/signature")


def load_index(spark: SparkSession, folder: str, corpus: DataFrame | None = None) -> SearchIndex | None:
    """The stored index; None when it is missing or was built from another corpus."""
    try:
        tables = {n: spark.read.parquet(f"{folder}/{n}") for n in ("doc_len", "postings", "vocabulary", "signature")}
    except AnalysisException:
        return None
    if corpus is not None:
        same = tables["signature"].join(signature(corpus, LAYOUT), "signature", "left_semi")
        if same.isEmpty():
            return None
    return SearchIndex(tables["doc_len"], tables["postings"], tables["vocabulary"])


def ensure_index(corpus: DataFrame, folder: str) -> SearchIndex:
    """Reuse the stored index while it fits the corpus, else rebuild it."""
    found = load_index(corpus.sparkSession, folder, corpus)
    if found is None:
        save_index(corpus, folder)
        found = load_index(corpus.sparkSession, folder)
    return found
