"""Hybrid search: BM25, nearest vectors, reciprocal-rank fusion and per-kind quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline import settings
from treeline.functions.tokens import mixed_pieces
from treeline.operators.distributed import first_per_key, top_ranked

KINDS = ("module", "symbol")


def tokenize_query(spark, query: str) -> list[str]:
    """Tokens of a query, by the same expression that reads the documents."""
    from treeline.functions.tokens import mixed_tokens

    return spark.range(1).select(mixed_tokens(F.lit(query)).alias("t")).head()["t"]


def term_table(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Per document: kind, doc_id, its length in tokens and the count of every query term.

    One narrow row per document leaves the scan; parts of one document add up.
    """
    pieces = docs.select("kind", "doc_id", mixed_pieces(F.col("text")).alias("_pieces"))
    hits = pieces.select(
        "kind", "doc_id", F.size("_pieces").alias("dl"),
        F.transform(F.filter("_pieces", lambda t: F.lower(t).isin(*terms)), F.lower).alias("_hits"),
    )
    counts = [F.sum(_occurrences(F.col("_hits"), word)).alias(f"tf{i}") for i, word in enumerate(terms)]
    return hits.groupBy("kind", "doc_id").agg(F.sum("dl").alias("dl"), *counts)


def _occurrences(tokens: Column, word: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == word))


def vocabulary(docs: DataFrame, multipart: bool = False) -> DataFrame:
    """Document frequency of every token: kind, token, df.

    Repeats inside a row are removed in place; only documents stored as several
    part rows need the distinct across rows.
    """
    tokens = docs.select(
        "kind", "doc_id", F.explode(F.array_distinct(F.transform(mixed_pieces(F.col("text")), F.lower))).alias("token")
    )
    if multipart:
        tokens = tokens.distinct()
    return tokens.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("df"))


def _raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def bm25_topk(
    docs: DataFrame, query_tokens: list[str], k: int = settings.PER_SIDE, vocab: DataFrame | None = None
) -> DataFrame:
    """Top `k` documents of each kind with a positive score: kind, doc_id, score, rank.

    The corpus statistics are at most one row per kind, which is what makes their
    broadcast safe; they come from the same narrow table the scores come from.
    """
    terms = list(dict.fromkeys(query_tokens))
    table = term_table(docs.filter(F.col("kind").isin(*KINDS)), terms)
    stats = table.groupBy("kind").agg(
        F.count("doc_id").alias("n"),
        F.sum("dl").alias("tokens"),
        *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
    )
    words = vocabulary(docs.filter(F.col("kind").isin(*KINDS)), multipart=True) if vocab is None else vocab
    mean = (
        words.join(F.broadcast(stats.select("kind", "n")), "kind")
        .groupBy("kind").agg(F.avg(_raw_idf(F.col("n"), F.col("df"))).alias("mean_idf"))
    )
    stats = stats.join(F.broadcast(mean), "kind", "left").withColumn("avgdl", F.try_divide("tokens", "n"))
    scored = table.join(F.broadcast(stats), "kind")
    score: Column = F.lit(0.0)
    for word in query_tokens:
        i = terms.index(word)
        raw = _raw_idf(F.col("n"), F.col(f"df{i}"))
        idf = F.when(F.col(f"df{i}") == 0, 0.0).when(
            raw < 0, settings.BM25_EPSILON * F.col("mean_idf")
        ).otherwise(raw)
        norm = settings.BM25_K1 * (
            1 - settings.BM25_B + settings.BM25_B * F.coalesce(F.try_divide("dl", "avgdl"), F.lit(0.0))
        )
        tf = F.col(f"tf{i}")
        score = score + idf * (tf * (settings.BM25_K1 + 1) / (tf + norm))
    ranked = first_per_key(
        scored.select("kind", "doc_id", score.alias("score")), ["kind"],
        [F.col("score").desc(), F.col("doc_id").asc()], k,
    )
    return ranked.filter("score > 0")


def squared_distance(vector: Column, query: list[float]) -> Column:
    """Squared Euclidean distance in double precision; the plan's size is the same for any dimension."""
    gaps = F.zip_with(vector.cast("array<double>"), F.lit([float(q) for q in query]), lambda a, b: a - b)
    return F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap)


def nearest(vectors: DataFrame, query: list[float], k: int = settings.PER_SIDE) -> DataFrame:
    """`k` nearest vectors of each kind: kind, doc_id, distance, rank."""
    scored = vectors.select("kind", "doc_id", squared_distance(F.col("embedding"), query).alias("distance"))
    return first_per_key(scored, ["kind"], [F.col("distance").asc(), F.col("doc_id").asc()], k)


def fuse(*rankings: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion per kind: kind, doc_id, rrf, rank; ties keep first-seen order."""
    merged = None
    for i, ranking in enumerate(rankings):
        rows = ranking.select("kind", "doc_id", "rank", F.lit(i).alias("source"))
        merged = rows if merged is None else merged.unionByName(rows)
    fused = merged.groupBy("kind", "doc_id").agg(
        F.sum(F.lit(1.0) / (F.col("rank") + settings.RRF_CONSTANT)).alias("rrf"),
        F.min(F.struct("source", "rank")).alias("seen"),
    )
    most = len(rankings) * settings.PER_SIDE
    return first_per_key(fused, ["kind"], [F.col("rrf").desc(), F.col("seen").asc()], most).drop("seen")


def quota_merge(fused: DataFrame, records: DataFrame, top_k: int = settings.DEFAULT_TOP_K) -> DataFrame:
    """Candidates by quota: side, position, key, score, and file and kind of a symbol.

    records: kind, doc_id, module_path, name and, if known, file and symbol_kind.
    Modules count once, with their best document.
    """
    module_quota = max(1, top_k // 2)
    symbol_quota = max(1, top_k - module_quota)
    named = records.join(F.broadcast(fused), ["kind", "doc_id"])
    score = F.round("rrf", settings.SCORE_DECIMALS)
    nothing = F.lit(None).cast("string")
    extra = [(F.col(c) if c in records.columns else nothing).alias(c) for c in ("file", "symbol_kind")]
    best = (
        named.filter((F.col("kind") == "module") & (F.coalesce("module_path", F.lit("")) != ""))
        .groupBy("module_path")
        .agg(F.min(F.struct("rank", "rrf")).alias("b"))
        .select(F.col("module_path").alias("key"), "b.rank", "b.rrf",
                nothing.alias("file"), nothing.alias("symbol_kind"))
    )
    modules = top_ranked(best, [F.col("rank").asc()], module_quota, "position")
    symbols = top_ranked(
        named.filter(F.col("kind") == "symbol").select(F.col("name").alias("key"), "rank", "rrf", *extra),
        [F.col("rank").asc()], symbol_quota, "position",
    )
    pick = lambda df, side: df.select(
        F.lit(side).alias("side"), "position", "key", score.alias("score"), "file", "symbol_kind")
    return pick(modules, "module").unionByName(pick(symbols, "symbol"))


def hit_counts(bm25: DataFrame, dense: DataFrame) -> DataFrame:
    """How many hits each retriever gave per kind, zero-filled."""
    tagged = bm25.select("kind", F.lit("bm25").alias("retriever")).unionByName(
        dense.select("kind", F.lit("dense").alias("retriever"))
    )
    one = tagged.agg(*[
        F.count_if((F.col("kind") == kind) & (F.col("retriever") == side)).alias(f"{side}_{kind}_hits")
        for kind in KINDS for side in ("bm25", "dense")
    ])
    return one
