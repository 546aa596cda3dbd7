"""Symbol definitions: validation, facts, lookups and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline import settings
from treeline.functions.paths import base_name, posix
from treeline.operators.attribution import with_module


def relative_file(path: Column, root: str | None = None) -> Column:
    """A path as the repository at `root` names its files, without `.` and `..` steps.

    Absolute paths below `root` lose it; any other absolute path stays as it is and
    matches no file.
    """
    plain = posix(path)
    if root is not None:
        front = root.replace("\\", "/").rstrip("/") + "/"
        plain = F.when(F.startswith(plain, F.lit(front)), F.substring(plain, F.lit(len(front) + 1), F.length(plain))).otherwise(plain)
    # A climb drops the step before it; climbs out of the repository stay.
    def step(done: Column, name: Column) -> Column:
        climbs = (name == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return (
            F.when(name.isin("", "."), done)
            .when(climbs, F.slice(done, 1, F.size(done) - 1))
            .otherwise(F.concat(done, F.array(name)))
        )

    steps = F.aggregate(F.split(plain, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(F.startswith(plain, F.lit("/")), "/").otherwise(""), F.array_join(steps, "/"))


def valid_tags(records: DataFrame, root: str | None = None) -> DataFrame:
    """Tag records that carry a name, path, line and kind; others are dropped.

    Files are named relative to the repository at `root`.
    """
    return records.filter(
        (F.col("_type") == "tag")
        & (F.col("name") != "") & (F.col("path") != "") & (F.col("kind") != "") & F.col("line").isNotNull()
    ).select(
        "name", relative_file(F.col("path"), root).alias("file"), F.col("line").cast("int").alias("line"), "kind", "signature"
    )


def symbol_facts(definitions: DataFrame, cards: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Definitions with their module (NULL when none matches).

    `paths` is a listing of the files; give it where definitions are costly to derive twice.
    """
    listing = definitions.select("file") if paths is None else paths
    return with_module(definitions, listing, cards).select(
        "name", "module_path", "file", "line", "kind", "signature"
    )


def kind_distribution(facts: DataFrame) -> DataFrame:
    """Counts of the reported kinds, zero-filled, plus the definitions without a module."""
    counters = [F.count_if(F.col("kind") == k).alias(k) for k in settings.REPORTED_KINDS]
    one = facts.agg(*counters, F.count_if(F.col("module_path").isNull()).alias("no_module"))
    names = [*settings.REPORTED_KINDS, "no_module"]
    return one.unpivot([], names, "kind", "n")


def find_definition(facts: DataFrame, name: str) -> DataFrame:
    """All definitions of exactly this name."""
    return facts.filter(F.col("name") == name)


def symbols_in_module(facts: DataFrame, module_path: str, kind: str | None = None) -> DataFrame:
    """Symbols of exactly this module, files by base name."""
    rows = facts.filter(F.col("module_path") == module_path)
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    return rows.select("name", "kind", base_name(F.col("file")).alias("file"), "line")


def kind_rank(kind: Column) -> Column:
    """Position in the preference order; unlisted and missing kinds come last."""
    order = F.array(*[F.lit(k) for k in settings.PREFERRED_KINDS])
    position = F.coalesce(F.array_position(order, kind), F.lit(0))
    return F.when(position > 0, position).otherwise(len(settings.PREFERRED_KINDS) + 1).cast("int")


def preferred_definition(facts: DataFrame) -> DataFrame:
    """The one definition of each name that represents it."""
    rest = [c for c in facts.columns if c != "name"]
    usable = facts.filter((F.col("file") != "") & F.col("line").isNotNull())
    best = usable.groupBy("name").agg(
        F.min_by(F.struct(*rest), F.struct(kind_rank(F.col("kind")), "file", "line")).alias("d")
    )
    return best.select("name", "d.*")
