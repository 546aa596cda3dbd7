"""Which module a path belongs to, and which modules lie inside others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions.paths import ancestors, clean_prefix


def module_prefixes(cards: DataFrame) -> DataFrame:
    """Distinct usable module paths; missing and empty ones are skipped."""
    return (
        cards.select(clean_prefix(F.col("module_path")).alias("module_path"))
        .filter(F.col("module_path") != "")
        .distinct()
    )


def attribute_modules(paths: DataFrame, cards: DataFrame, path: str = "file") -> DataFrame:
    """Each path that lies in a module, with its longest module prefix.

    Only paths travel, never texts. A prefix shared by very many paths costs no
    single task: either the modules measure small enough to be broadcast at run
    time, or the skewed partition is split; what remains per path is a handful of rows.
    """
    candidates = paths.select(path, F.explode(ancestors(F.col(path))).alias("module_path"))
    hits = candidates.join(module_prefixes(cards), "module_path")
    return hits.groupBy(path).agg(F.max_by("module_path", F.length("module_path")).alias("module_path"))


def with_module(
    facts: DataFrame, paths: DataFrame, cards: DataFrame, path: str = "file", keep_unmatched: bool = True
) -> DataFrame:
    """Attach `module_path` to facts; unmatched facts are kept with NULL or dropped.

    `paths` lists the files the facts came from, so attribution reads path
    columns only and the texts behind the facts are parsed once.
    """
    return facts.join(attribute_modules(paths, cards, path), path, "left" if keep_unmatched else "inner")


def outermost(paths: DataFrame, path: str = "path") -> DataFrame:
    """Distinct paths that lie inside no other of the paths."""
    distinct = paths.select(path).distinct()
    above = distinct.select(path, F.explode(ancestors(F.col(path), include_self=False)).alias("outer_path"))
    inside = above.join(distinct.select(F.col(path).alias("outer_path")), "outer_path", "left_semi").select(path)
    return distinct.join(inside.distinct(), path, "left_anti")
