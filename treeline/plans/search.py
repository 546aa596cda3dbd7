"""Queries over names, tokens, the corpus and hybrid search (q18-q25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.comments import line_fragments
from treeline.functions.tokens import mixed_pieces, name_tokens
from treeline.operators import corpus, rankedindex, retrieval, vectorstore
from treeline.plans import facts, standins
from treeline.session import work_folder
from treeline.sources.tables import table

QUERY = "the hentive Ciónllcita mente unger_Reou Mente"


def _words(text):
    """Comment fragments of the Latin test corpus: runs of six letters or more."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z]{6,}"), F.lit(0))


def q18_related_comments(spark: SparkSession, folder: str) -> DataFrame:
    commented = standins.code_files(spark, folder).select(
        "file", line_fragments(F.col("text"), _words).alias("fragments")
    )
    return corpus.related_comments(facts.definitions(spark, folder), commented).select("name", "related")


def q19_name_tokens(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    names = F.array(
        F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")),
        F.replace(F.col("p_name"), F.lit(" "), F.lit("_")),
        F.concat(F.upper("p_type"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))),
        F.col("p_brand"),
        F.concat_ws("/", F.lower("p_type"), F.concat(F.lit("v"), F.col("p_size").cast("string")), F.lit("HTTPServer2.h")),
    )
    return part.select("p_partkey", F.posexplode(names).alias("form", "name")).select(
        "p_partkey", "form", "name", name_tokens(F.col("name")).alias("tokens")
    )


def q20_token_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    pieces = standins.files(spark, folder).select(F.explode(mixed_pieces(F.col("text"))).alias("piece"))
    return pieces.groupBy(F.lower("piece").alias("token")).agg(F.count(F.lit(1)).alias("n"))


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    """documents as corpus rows: sources with an even number are modules, the others symbols."""
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    return standins.files(spark, folder).select(
        F.when(F.pmod(number, F.lit(2)) == 0, "module").otherwise("symbol").alias("kind"), "doc_id", "text"
    )


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.when(F.pmod("vec_id", F.lit(2)) == 0, "module").otherwise("symbol").alias("kind"),
        F.col("vec_id").alias("doc_id"), "embedding",
    )


def _query_vector(spark: SparkSession, folder: str) -> list[float]:
    return table(spark, folder, "embeddings").filter("vec_id = 0").select("embedding").head()["embedding"]


def _bm25(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.bm25_topk(_docs(spark, folder), retrieval.tokenize_query(spark, QUERY))


def _nearest(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.nearest(_vectors(spark, folder), _query_vector(spark, folder))


def q21_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return _bm25(spark, folder).select("kind", "rank", "doc_id", F.round("score", 6).alias("score"))


def q22_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return _nearest(spark, folder).select("kind", "rank", "doc_id", F.round("distance", 6).alias("distance"))


def q21_stored_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """The ranking of q21 from a stored index, which it builds first."""
    index = rankedindex.refreshed_index(_docs(spark, folder), work_folder(spark, "index"))
    ranked = index.bm25(retrieval.tokenize_query(spark, QUERY))
    return ranked.select("kind", "rank", "doc_id", F.round("score", 6).alias("score"))


def q21_index_upkeep(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequencies of an index that was built from former documents and then brought up to date.

    Formerly every tenth document was missing, every seventh had other words, and some were
    there that are none now.
    """
    docs = _docs(spark, folder)
    former = docs.filter(F.pmod("doc_id", F.lit(10)) != 3).withColumn(
        "text", F.when(F.pmod("doc_id", F.lit(7)) == 2, F.concat(F.lit("former words "), "text")).otherwise(F.col("text"))
    )
    dropped = docs.filter(F.pmod("doc_id", F.lit(50)) == 1).withColumn("doc_id", -F.col("doc_id"))
    index = rankedindex.refreshed_index(former.unionByName(dropped), work_folder(spark, "index"))
    return index.update(docs).vocabulary()


def q22_stored_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest vectors of q22 from vectors stored by pivots."""
    index = vectorstore.build_vectors(_vectors(spark, folder), work_folder(spark, "vectors"))
    found = index.nearest(_query_vector(spark, folder))
    return found.select("kind", "rank", "doc_id", F.round("distance", 6).alias("distance"))


def q23_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.fuse(_bm25(spark, folder), _nearest(spark, folder)).select(
        "kind", "rank", "doc_id", F.round("rrf", 6).alias("rrf")
    )


def q24_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "documents").select(
        F.when(
            F.pmod(F.regexp_extract("source", "[0-9]+", 0).cast("int"), F.lit(2)) == 0, "module"
        ).otherwise("symbol").alias("kind"),
        "doc_id", F.col("source").alias("module_path"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"),
    )
    fused = retrieval.fuse(_bm25(spark, folder), _nearest(spark, folder))
    return retrieval.quota_merge(fused, records).select("side", "position", "key", "score")


def q24_hit_counts(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.hit_counts(_bm25(spark, folder), _nearest(spark, folder))


def _corpus_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Module and symbol documents of the code view; every third document is a documentation file."""
    view = standins.code_files(spark, folder)
    plain = standins.files(spark, folder)
    is_doc = F.pmod("doc_id", F.lit(3)) == 0
    commented = view.select("file", line_fragments(F.col("text"), _words).alias("fragments"))
    sources = view.filter(~is_doc).select("file", F.col("source").alias("module_path"))
    comments = corpus.module_comments(
        sources, view.filter(~is_doc).select("file", line_fragments(F.col("text"), _words).alias("fragments"))
    )
    documents = plain.filter(is_doc).select(F.col("source").alias("module_path"), F.col("file").alias("part"), "text")
    none = F.array().cast("array<string>")
    cards = standins.modules(spark, folder).select(
        "module_path", F.upper("module_path").alias("module_name"), F.lit(None).cast("string").alias("module_type"),
        F.array(F.concat("module_path", F.lit("/main.cpp"))).alias("entry_files"),
        none.alias("extra_key_files"), none.alias("config_files"), none.alias("doc_files"),
    )
    definitions = facts.definitions(spark, folder).withColumn("module_path", F.substring_index("file", "/", 1))
    symbols = corpus.symbol_documents(corpus.related_comments(definitions, commented))
    return corpus.module_documents(cards, comments, documents), symbols


def q18_module_comments(spark: SparkSession, folder: str) -> DataFrame:
    view = standins.code_files(spark, folder)
    commented = view.select("file", line_fragments(F.col("text"), _words).alias("fragments"))
    return corpus.module_comments(view.select("file", F.col("source").alias("module_path")), commented)


def q25_corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.corpus_stats(corpus.corpus(*_corpus_rows(spark, folder)))


def q25_symbol_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _corpus_rows(spark, folder)[1].select("doc_id", "module_path", "text", "has_comments")
