"""Include facts, header lookups and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline import settings
from treeline.functions.comments import includes_of
from treeline.functions.paths import base_name
from treeline.functions.text import strip
from treeline.operators.attribution import with_module
from treeline.operators.distributed import top_ranked


def include_facts(files: DataFrame, cards: DataFrame) -> DataFrame:
    """One row per distinct include: basename, include_target, module_path, file, line, raw, commented.

    Equal directives can only repeat inside one file, so duplicates are removed
    inside its row and no shuffle of facts is needed for it.
    """
    hits = F.array_distinct(
        F.transform(
            includes_of(F.col("text")),
            lambda h: F.struct(
                h["line"].alias("line"),
                strip(h["raw"]).alias("raw"),
                strip(h["target"]).alias("include_target"),
                h["commented"].alias("commented"),
            ),
        )
    )
    facts = (
        files.select("file", F.explode(hits).alias("h"))
        .select("file", "h.*")
        .withColumn("basename", base_name(F.col("include_target")))
        .filter((F.col("include_target") != "") & (F.col("basename") != ""))
    )
    return with_module(facts, files.select("file"), cards, keep_unmatched=False).select(
        "basename", "include_target", "module_path", "file", "line", "raw", "commented"
    )


def include_graph(facts: DataFrame, header: str) -> DataFrame:
    """Who includes a header: rows (facet, key, refs) for modules, spellings and the total."""
    hits = facts.filter(F.col("basename") == header)
    counted = hits.groupBy("module_path", "include_target").agg(F.count(F.lit(1)).alias("n"))
    facets = counted.select(
        F.explode(
            F.array(
                F.struct(F.lit("module").alias("facet"), F.col("module_path").alias("key")),
                F.struct(F.lit("writing").alias("facet"), F.col("include_target").alias("key")),
                F.struct(F.lit("total").alias("facet"), F.lit(header).alias("key")),
            )
        ).alias("f"),
        "n",
    )
    return facets.groupBy("f.facet", "f.key").agg(F.sum("n").alias("refs"))


def header_ranking(facts: DataFrame, n: int = settings.TOP_NAMES) -> DataFrame:
    """Most included header names with their commented share: rank, basename, refs, commented_refs."""
    counts = facts.groupBy("basename").agg(
        F.count(F.lit(1)).alias("refs"), F.count_if("commented").alias("commented_refs")
    )
    return top_ranked(counts, [F.col("refs").desc(), F.col("basename").asc()], n)
