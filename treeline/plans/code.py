"""Queries over files, modules, includes, symbols and references (q01-q19, q39-q42)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.paths import base_name, glob_regex, matches_glob
from treeline.functions.text import split_lines
from treeline.operators import attribution, includes, references, symbols, textsearch
from treeline.plans import facts, standins
from treeline.sources.tables import table


def q01_lines_per_module(spark: SparkSession, folder: str) -> DataFrame:
    return (
        standins.files(spark, folder)
        .groupBy(F.col("source").alias("module_path"))
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum(F.size(split_lines(F.col("text")))).alias("lines"),
            F.sum(F.length("text")).alias("chars"),
        )
    )


def q02_list_modules(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "documents")
        .groupBy(F.col("source").alias("module_path"))
        .agg(F.min("lang").alias("module_type"))
        .select("module_path", F.upper("module_path").alias("module_name"), "module_type")
    )


def q03_list_directory(spark: SparkSession, folder: str) -> DataFrame:
    return textsearch.list_directory(standins.page_paths(spark, folder))


def q04_find_files(spark: SparkSession, folder: str) -> DataFrame:
    return textsearch.find_files(standins.page_paths(spark, folder), "7")


def q05_search_text(spark: SparkSession, folder: str) -> DataFrame:
    return textsearch.search_text(standins.files(spark, folder), "tion", "src3")


def q06_read_window(spark: SparkSession, folder: str) -> DataFrame:
    start = F.pmod(F.col("doc_id") * 5, F.lit(23)).cast("int") + 1
    end = F.pmod(F.col("doc_id") * 7, F.lit(260)).cast("int") + 1
    return textsearch.read_window(standins.files(spark, folder), start, end).select(
        "file", "total_lines", "start_line", "end_line", "truncated", "content", "characters_read"
    )


def q06_read_preview(spark: SparkSession, folder: str) -> DataFrame:
    return textsearch.read_preview(standins.files(spark, folder)).select(
        "file", "total_lines", "start_line", "end_line", "content", "characters_read"
    )


def _page_modules(spark: SparkSession, folder: str) -> DataFrame:
    """Every host that has a subdomain is a module, and so is every host/lang."""
    parts = F.split("path", "/")
    path = standins.page_paths(spark, folder)
    return path.select(
        F.explode(
            F.array_compact(F.array(
                F.when(F.size(F.split(parts[0], r"\.")) > 3, parts[0]),
                F.when(F.get(parts, F.lit(1)) == "en", F.concat_ws("/", parts[0], F.lit("en"))),
            ))
        ).alias("module_path")
    ).distinct()


def q07_longest_prefix(spark: SparkSession, folder: str) -> DataFrame:
    paths = standins.page_paths(spark, folder)
    return attribution.with_module(paths, paths, _page_modules(spark, folder), "path").select(
        "page_id", "path", "module_path"
    )


def _include_facts(spark: SparkSession, folder: str) -> DataFrame:
    return includes.include_facts(standins.code_files(spark, folder), standins.modules(spark, folder))


def q08_include_facts(spark: SparkSession, folder: str) -> DataFrame:
    return _include_facts(spark, folder)


def q09_include_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return includes.include_graph(_include_facts(spark, folder), "The.h")


def q10_top_headers(spark: SparkSession, folder: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    facts_ = (
        table(spark, folder, "pages").select(F.explode(links).alias("target"))
        .select(base_name(F.col("target")).alias("basename"), F.lit(False).alias("commented"))
        .filter("basename <> ''")
    )
    return includes.header_ranking(facts_).select("rank", "basename", "refs")


def q10_top_headers_commented(spark: SparkSession, folder: str) -> DataFrame:
    return includes.header_ranking(_include_facts(spark, folder))


def _symbols(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.symbol_facts(
        facts.definitions(spark, folder), standins.modules(spark, folder), standins.files(spark, folder).select("file")
    )


def q11_symbol_facts(spark: SparkSession, folder: str) -> DataFrame:
    return _symbols(spark, folder).select("name", "module_path", "file", "line", "kind")


def q11_kind_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.kind_distribution(_symbols(spark, folder))


def q12_find_definition(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.find_definition(_symbols(spark, folder), "Anhaha").select(
        "name", "module_path", "file", "line", "kind"
    )


def q13_symbols_in_module(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.symbols_in_module(_symbols(spark, folder), "src3", "class")


def _references(spark: SparkSession, folder: str) -> DataFrame:
    return references.reference_facts(
        standins.files(spark, folder), facts.definitions(spark, folder), standins.modules(spark, folder)
    )


def q14_reference_facts(spark: SparkSession, folder: str) -> DataFrame:
    return _references(spark, folder)


def q14_source_files(spark: SparkSession, folder: str) -> DataFrame:
    """Linked files as definitions: which of them a scan would read."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    ends = F.array(*[F.lit(e) for e in (".h", ".CPP", ".py", "", ".hxx", ".md")])
    named = table(spark, folder, "pages").select("page_id", F.explode(links).alias("target")).select(
        F.concat(F.ltrim(F.regexp_replace("target", "[?#].*$", ""), F.lit("/")), ends[F.pmod("page_id", F.lit(6)).cast("int")]).alias("file")
    )
    return references.source_files(named)


def q14_literal_references(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "part").select(
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("file"),
        F.concat_ws(" ", "p_brand", F.concat(F.lit("~"), F.col("p_name")), "p_type", "p_brand").alias("text"),
    )
    names = ["Brand#2", "Brand#12", "~hot", "~blue ring", "~large"]
    return references.literal_hits(lines, names)


def q14_special_references(spark: SparkSession, folder: str) -> DataFrame:
    """Names with other characters, taken from the parts, found in the lines of the parts."""
    part = table(spark, folder, "part")
    first = F.substring_index("p_name", " ", 1)
    names = part.select(
        F.explode(F.array(F.col("p_brand"), F.concat(F.lit("~"), first), F.concat(F.col("p_type"), F.lit(" Brand#1")))).alias("name")
    )
    lines = part.select(
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("file"),
        F.concat_ws(" ", "p_brand", F.concat(F.lit("~"), "p_name"), "p_type", "p_brand", "p_type").alias("text"),
    )
    return references.special_hits(lines, names)


def q15_reference_summary(spark: SparkSession, folder: str) -> DataFrame:
    return references.reference_summary(_references(spark, folder))


def q15_top_referenced(spark: SparkSession, folder: str) -> DataFrame:
    return references.top_referenced(_references(spark, folder))


def q15_sample_references(spark: SparkSession, folder: str) -> DataFrame:
    samples = references.sample_references(_references(spark, folder), 5)
    return references.with_context(samples, standins.files(spark, folder)).select(
        "name", "rank", "module_path", "file", "line", "context"
    )


def q15_scoped_references(spark: SparkSession, folder: str) -> DataFrame:
    scoped = _references(spark, folder).filter(F.col("module_path") == "src3")
    return references.module_counts(scoped)


def q16_unreferenced(spark: SparkSession, folder: str) -> DataFrame:
    defined = facts.definitions(spark, folder)
    found = references.reference_facts(standins.files(spark, folder), defined, standins.modules(spark, folder))
    return references.unreferenced(defined, found)


def q17_preferred_definition(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.preferred_definition(facts.all_definitions(spark, folder))


def q39_outermost(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.split("path", "/")
    paths = standins.page_paths(spark, folder)
    mixed = paths.select(
        F.when(F.pmod("page_id", F.lit(6)) == 0, F.slice(parts, 1, 2)).otherwise(parts).alias("parts")
    ).select(F.array_join("parts", "/").alias("path"))
    return attribution.outermost(mixed)


def q42_glob_match(spark: SparkSession, folder: str) -> DataFrame:
    paths = standins.page_paths(spark, folder)
    patterns = ["**/en/*", "*.example.net/**", "**/5??", "blog.*/*/*.html", "**/*.html"]
    flags = [matches_glob(F.col("path"), p).alias(f"g{i}") for i, p in enumerate(patterns)]
    return paths.select("page_id", *flags)
