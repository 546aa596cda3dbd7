"""The retrieval corpus: module documents and symbol documents.

A module's collected documentation can be arbitrarily large, so it is kept as
ordered part rows sharing one doc_id and is never glued into a single value;
length and term counts of the whole document are sums over its parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline import settings
from treeline.functions.comments import C_COMMENT, HASH_COMMENT, line_fragments
from treeline.functions.paths import suffix
from treeline.functions.tokens import cjk_fragments, name_tokens
from treeline.operators.distributed import first_per_key


#: Lines of a band; a window of 61 lines touches three at most.
BAND = settings.COMMENT_WINDOW + 1


def comments_by_suffix(file: Column, text: Column, fragments: Callable[[Column], Column]) -> Column:
    """Comment fragments per line, by the comment style of the file's suffix."""
    return F.when(suffix(file).isin(*settings.C_SUFFIXES), line_fragments(text, fragments, C_COMMENT)).when(
        suffix(file).isin(*settings.PYTHON_SUFFIXES), line_fragments(text, fragments, HASH_COMMENT)
    )


def commented_lines(
    files: DataFrame, fragments: Callable[[Column], Column] = cjk_fragments
) -> DataFrame:
    """Files with their comment fragments per line: file, fragments array<array<string>>."""
    return files.select("file", comments_by_suffix(F.col("file"), F.col("text"), fragments).alias("fragments"))


def related_comments(definitions: DataFrame, commented: DataFrame) -> DataFrame:
    """Distinct comment fragments within 30 lines of each definition, in order, cut to 1,000 characters.

    A band join: files are cut into bands of BAND lines, each place meets the two or three bands
    that its window touches, and the pieces of a window are put together in order. No row
    carries more of a file than a band, whatever the file's size and number of definitions.
    """
    band_of = lambda line: F.floor((line - 1) / BAND).cast("int")
    count = F.ceil(F.size("fragments") / BAND).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))
    bands = F.transform(starts, lambda i: F.slice("fragments", i * BAND + 1, BAND))
    bands = commented.select("file", F.posexplode(bands).alias("band", "lines"))
    bands = bands.filter(F.exists("lines", lambda fragments: F.size(fragments) > 0))
    first = F.greatest(F.lit(1), F.col("line") - settings.COMMENT_WINDOW)
    last = F.col("line") + settings.COMMENT_WINDOW
    places = definitions.filter("file IS NOT NULL AND line IS NOT NULL").select("file", "line").distinct()
    places = places.select("file", "line", F.explode(F.sequence(band_of(first), band_of(last))).alias("band"))
    skip = F.greatest(first - F.col("band") * BAND, F.lit(1))
    piece = F.slice("lines", skip, F.greatest(last - F.col("band") * BAND - skip + 1, F.lit(0)))
    met = places.join(bands, ["file", "band"]).select("file", "line", "band", F.flatten(piece).alias("piece"))
    # At most three bands a place.
    pieces = F.sort_array(F.collect_list(F.struct("band", "piece")))["piece"]
    joined = F.array_join(F.array_distinct(F.flatten(pieces)), " ")
    related = met.groupBy("file", "line").agg(F.substring(joined, 1, settings.SYMBOL_COMMENT_CHARS).alias("related"))
    return definitions.join(related, ["file", "line"], "left").select(
        *definitions.columns, F.coalesce("related", F.lit("")).alias("related")
    )


def module_comments(files: DataFrame, commented: DataFrame) -> DataFrame:
    """Per module the distinct fragments of its source comments in path order, cut to 5,000 characters.

    A fragment has at least two characters and a separator, so only the first
    5000/3 distinct ones of a module can count; the others never travel.
    """
    most = settings.MODULE_COMMENT_CHARS // 3 + 1
    owned = files.select("file", "module_path").filter("module_path IS NOT NULL").join(commented, "file")
    rows = owned.select(
        "module_path", "file", F.posexplode(F.flatten("fragments")).alias("position", "fragment")
    )
    firsts = rows.groupBy("module_path", "fragment").agg(F.min(F.struct("file", "position")).alias("at"))
    kept = first_per_key(firsts, ["module_path"], [F.col("at").asc()], most)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "fragment")))["fragment"]
    return kept.groupBy("module_path").agg(
        F.substring(F.array_join(ordered, " "), 1, settings.MODULE_COMMENT_CHARS).alias("comments")
    )


def symbol_documents(related: DataFrame) -> DataFrame:
    """One document per symbol name from its preferred definition and related comments."""
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("[symbol] "), "name"),
        F.concat(F.lit("kind: "), F.coalesce("kind", F.lit(""))),
        F.concat(F.lit("file: "), F.coalesce("file", F.lit(""))),
        F.concat(F.lit("module_path: "), F.coalesce("module_path", F.lit(""))),
        F.concat(F.lit("name_tokens: "), name_tokens(F.col("name"))),
        F.concat(F.lit("signature: "), F.coalesce("signature", F.lit(""))),
        F.lit(""),
        F.lit("related_chinese:"),
        F.col("related"),
    )
    return related.select(
        F.concat(F.lit("symbol:"), "name").alias("doc_id"),
        F.lit("symbol").alias("kind"),
        F.nullif(F.col("module_path"), F.lit("")).alias("module_path"),
        F.lit("").alias("part"),
        text.alias("text"),
        (F.col("related") != "").alias("has_comments"),
        F.struct(
            F.col("name"), F.coalesce("kind", F.lit("")).alias("symbol_kind"), F.col("file"), F.col("line"),
            F.lit(None).cast("string").alias("module_name"), F.lit(None).cast("string").alias("module_type"),
            F.lit(None).cast("array<string>").alias("config_files"),
            F.lit(None).cast("array<string>").alias("doc_files"),
        ).alias("metadata"),
    )


def module_documents(cards: DataFrame, comments: DataFrame, documents: DataFrame) -> DataFrame:
    """`#meta`, `#comments` and `#docs` documents of each module.

    cards: module catalog with `extra_key_files`; comments: module_path, comments;
    documents: module_path, part (sort key), text — the module's documentation files.
    """
    listed = lambda c: F.array_join(F.filter(c, lambda x: x != ""), " ")
    key_files = F.concat(
        F.filter("entry_files", lambda x: x != ""),
        F.array_except(F.coalesce("extra_key_files", F.array().cast("array<string>")), "entry_files"),
    )
    meta_text = F.concat_ws(
        "\n",
        F.concat(F.lit("[module] "), "module_path"),
        F.concat(F.lit("module_name: "), F.coalesce("module_name", F.lit(""))),
        F.concat(F.lit("module_type: "), F.coalesce("module_type", F.lit(""))),
        F.concat(F.lit("path_tokens: "), name_tokens(F.coalesce("module_name", F.lit("")))),
        F.concat(F.lit("key_files: "), listed(key_files)),
        F.concat(F.lit("config_files: "), listed(F.col("config_files"))),
        F.concat(F.lit("doc_files: "), listed(F.col("doc_files"))),
    )
    metadata = F.struct(
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("symbol_kind"),
        F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"),
        F.col("module_name"), F.col("module_type"), F.col("config_files"), F.col("doc_files"),
    ).alias("metadata")
    known = cards.filter(F.col("module_path") != "")

    def rows(df: DataFrame, part_of: str, part: Column, text: Column) -> DataFrame:
        return df.select(
            F.concat(F.lit("module:"), "module_path", F.lit("#" + part_of)).alias("doc_id"),
            F.lit("module").alias("kind"), "module_path", part.alias("part"), text.alias("text"),
            F.lit(part_of == "comments").alias("has_comments"), metadata,
        )

    def titled(kind: str) -> Column:
        return F.concat(F.lit(f"[module-{kind}] "), F.col("module_path"))

    texts = documents.filter(F.col("text") != "")
    commented = known.join(comments.filter(F.col("comments") != ""), "module_path")
    with_docs = known.join(texts.select("module_path").distinct(), "module_path", "left_semi")
    body = known.join(texts, "module_path")
    return (
        rows(known, "meta", F.lit(""), meta_text)
        .unionByName(rows(commented, "comments", F.lit(""), F.concat_ws("\n", titled("comments"), F.col("comments"))))
        .unionByName(rows(with_docs, "docs", F.lit(""), titled("docs")))
        .unionByName(rows(body, "docs", F.col("part"), F.col("text")))
    )


def corpus(module_docs: DataFrame, symbol_docs: DataFrame) -> DataFrame:
    return module_docs.unionByName(symbol_docs)


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Document counts by kind and part, documents with comments and total characters."""
    per_doc = docs.groupBy("kind", "doc_id").agg(
        (F.sum(F.length("text")) + F.count(F.lit(1)) - 1).alias("chars"), F.max("has_comments").alias("has_comments")
    )
    module, symbol = F.col("kind") == "module", F.col("kind") == "symbol"
    return per_doc.agg(
        F.count_if(module).alias("module_docs"),
        F.count_if(module & F.col("doc_id").endswith("#meta")).alias("module_meta_docs"),
        F.count_if(module & F.col("doc_id").endswith("#comments")).alias("module_comments_docs"),
        F.count_if(module & F.col("doc_id").endswith("#docs")).alias("module_document_docs"),
        F.count_if(symbol).alias("symbol_docs"),
        F.count(F.lit(1)).alias("total_docs"),
        F.count_if(module & F.col("has_comments")).alias("module_with_comments"),
        F.count_if(symbol & F.col("has_comments")).alias("symbol_with_comments"),
        F.sum("chars").alias("total_chars"),
    )
