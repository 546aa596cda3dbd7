"""From a repository folder to written fact tables, and back."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline import settings
from treeline.functions.paths import suffix
from treeline.operators import catalog, corpus, includes, rankedindex, references, symbols, vectorstore
from treeline.sources import jsonlines, repository
from treeline.sources.segments import GONE, Segments, open_store
from treeline.toolbox import Tables

TABLES = ("cards", "symbols", "module_symbols", "references", "corpus")
#: Tables that edits change: stores of segments by file.
BY_FILE = ("files", "includes")


def documentation(files: DataFrame, owned: DataFrame, cards: DataFrame) -> DataFrame:
    """Documentation texts per module: the card's files first, then every other Markdown file, by path."""
    listed = cards.select("module_path", F.explode("doc_files").alias("relative"), F.lit("0").alias("_group"))
    markdown = owned.filter(suffix(F.col("file")).isin(*settings.MARKDOWN_SUFFIXES))
    order = owned.join(listed, ["module_path", "relative"]).unionByName(
        markdown.join(listed, ["module_path", "relative"], "left_anti").withColumn("_group", F.lit("1"))
    )
    return order.join(files, "file").select("module_path", F.concat_ws("/", "_group", "relative").alias("part"), "text")


def include_facts(files: DataFrame, cards: DataFrame) -> DataFrame:
    sources = files.filter(suffix(F.col("file")).isin(*settings.C_SUFFIXES))
    return includes.include_facts(sources, cards)


def rebuilt(store: Segments, name: str, df: DataFrame, *order: str) -> DataFrame:
    """Put a table in place of all that the store holds; returns its rows."""
    draft = store.draft()
    draft.put(name, df, *order)
    return draft.commit(replace_all=True).read(name)


def refresh_file_facts(spark: SparkSession, out: str, files: list[str]) -> DataFrame:
    """All include facts, those of these files anew from their present texts; no other text is read."""
    stores = {name: open_store(spark, f"{out}/{name}", ["file"]) for name in BY_FILE}
    keys = spark.createDataFrame([(f,) for f in files], "file string")
    changed = stores["files"].read("files").filter(F.col("file").isin(files))
    draft = stores["includes"].draft()
    draft.put("includes", include_facts(changed, spark.read.parquet(f"{out}/cards")), "basename", "file", "line")
    draft.put(GONE, keys)
    return draft.commit().read("includes")


def build_tables(spark: SparkSession, root: str, tags: str, out: str, embed_batch=None) -> None:
    """Read a repository and a tag file and write every table below `out`.

    Each stage reads the written result of the ones before it, so a lost executor
    or a restart repeats one stage at most. `embed_batch` (texts -> vectors) adds the
    vectors of the corpus; without it, searches rank by BM25 alone. A build over an
    earlier one brings its search index up to date instead of making a new one.
    """
    def store(name: str, df: DataFrame, *order: str) -> DataFrame:
        """Write a table; in key order where lookups go by key, so they skip row groups."""
        if order:
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    files = rebuilt(Segments(spark, f"{out}/files", ["file"]), "files", repository.read_texts(spark, root), "file")
    # Directory lists of cards name every directory, also those that are not read.
    listing = repository.listed_files(spark, root, prune=False)
    cards = store("cards", catalog.cards_of(listing.join(files, "file", "left")))
    sources = files.filter(suffix(F.col("file")).isin(*settings.C_SUFFIXES))
    rebuilt(Segments(spark, f"{out}/includes", ["file"]), "includes", include_facts(files, cards), "basename", "file", "line")
    facts = symbols.symbol_facts(jsonlines.read_tags(spark, tags, urlsplit(repository.location(root)).path), cards, files.select("file"))
    defined = store("symbols", facts, "name", "file", "line")
    store("module_symbols", defined.filter("module_path IS NOT NULL"), "module_path", "file", "line")
    scanned = sources.join(references.source_files(defined), "file", "left_semi")
    found = references.reference_facts(scanned, defined, cards, references.symbol_hits(scanned, defined))
    store("references", references.with_context(found, scanned), "name", "file", "line")

    owned = catalog.module_files(files.select("file"), cards.select("module_path"))
    in_src = owned.filter(F.col("relative").startswith("src/")).select("module_path", "file")
    commented = corpus.commented_lines(
        files.filter(suffix(F.col("file")).isin(*settings.C_SUFFIXES, *settings.PYTHON_SUFFIXES))
    )
    module_docs = corpus.module_documents(
        cards, corpus.module_comments(in_src, commented), documentation(files, owned, cards)
    )
    symbol_docs = corpus.symbol_documents(
        corpus.related_comments(symbols.preferred_definition(defined), commented)
    )
    written = store("corpus", corpus.corpus(module_docs, symbol_docs))
    rankedindex.refreshed_index(written, f"{out}/index")
    if embed_batch is not None:
        vectors = embed_corpus(written.filter(F.col("kind").isin(*rankedindex.KINDS)), embed_batch)
        vectorstore.build_vectors(vectors, f"{out}/vectors")


def load_tables(spark: SparkSession, out: str) -> Tables:
    """The written tables; a missing one stays None and its tools say so."""
    def read(name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{out}/{name}")
        except AnalysisException:
            return None

    found = {name: read(name) for name in TABLES}
    stores = {name: open_store(spark, f"{out}/{name}", ["file"]) for name in BY_FILE}
    found |= {name: store.read(name) if store else None for name, store in stores.items()}
    records = None
    if found["corpus"] is not None:
        records = found["corpus"].filter("part = ''").select(
            "kind", "doc_id", "module_path", F.col("metadata.name").alias("name"),
            F.col("metadata.file").alias("file"), F.col("metadata.symbol_kind").alias("symbol_kind"),
        ).dropDuplicates(["kind", "doc_id"])
    return Tables(
        **found, records=records, index=rankedindex.open_index(spark, f"{out}/index"),
        vector_index=vectorstore.open_vectors(spark, f"{out}/vectors"), file_store=stores["files"],
        refresh=lambda files: refresh_file_facts(spark, out, files),
    )


def embed_corpus(docs: DataFrame, embed_batch, batch: int = settings.EMBED_BATCH) -> DataFrame:
    """Vectors of the corpus from a caller's batch embedding function (list of texts -> list of vectors).

    Called on at most `batch` texts at a time, where the rows are. A document in
    parts is embedded part by part and represented by the mean of its parts.
    """
    import pandas as pd

    def vectors(batches):
        for pdf in batches:
            out = []
            for start in range(0, len(pdf), batch):
                out += [list(map(float, v)) for v in embed_batch(list(pdf["text"][start:start + batch]))]
            yield pd.DataFrame({"kind": pdf["kind"], "doc_id": pdf["doc_id"], "embedding": out})

    schema = "kind string, doc_id string, embedding array<float>"
    parts = docs.select("kind", "doc_id", "text").mapInPandas(vectors, schema)
    spread = parts.select("kind", "doc_id", F.posexplode("embedding").alias("i", "x"))
    means = spread.groupBy("kind", "doc_id", "i").agg(F.avg("x").cast("float").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])
    return means.groupBy("kind", "doc_id").agg(ordered.alias("embedding"))
