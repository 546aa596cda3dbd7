"""Symbol stand-ins shared by several registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.text import split_lines
from treeline.functions.tokens import identifiers
from treeline.plans import standins


def name_lines(files: DataFrame, *columns: Column | str) -> DataFrame:
    """Every identifier where it occurs: name, and columns made of doc_id and line."""
    lines = files.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("_i", "_line"))
    numbered = lines.select("doc_id", (F.col("_i") + 1).alias("line"), "_line")
    return numbered.select(*columns, F.explode(identifiers(F.col("_line"))).alias("name"))


def first_lines(files: DataFrame) -> DataFrame:
    """First line of every identifier in every file: name, doc_id, line."""
    return name_lines(files, "doc_id", "line").groupBy("name", "doc_id").agg(F.min("line").alias("line"))


def definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Every name, defined where it first occurs: name, file, line, kind, signature.

    Document and line stand in one number, so that names meet at once, one row of each a task, and
    none per name and document is shuffled. Uses that need different columns still share one
    aggregation, because the validity filter reads all of them.
    """
    listing = standins.files(spark, folder).select("doc_id", "file")
    lines = F.lit(1 << 32).cast("decimal(10,0)")
    place = F.col("doc_id").cast("decimal(19,0)") * lines + F.col("line").cast("decimal(10,0)")
    per_name = (
        name_lines(standins.files(spark, folder), place.alias("place"))
        .groupBy("name")
        .agg(F.min("place").alias("place"))
        .withColumn("line", F.pmod("place", lines))
        .select(
            "name", ((F.col("place") - F.col("line")) / lines).cast("long").alias("doc_id"), F.col("line").cast("int").alias("line")
        )
        .filter(F.col("doc_id").isNotNull() & (F.col("line") > 0))
    )
    return per_name.join(listing, "doc_id").select(
        "name", "file", "line", standins.kind_of(F.col("name")).alias("kind"),
        F.lit(None).cast("string").alias("signature"),
    )


def all_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Several definitions per name: one in each document that holds it, the kind by document.

    Texts meet by document before they are taken apart, so that no row per name and document is
    shuffled, neither to find first lines nor to meet the listing (hashed: nothing is sorted for it).
    """
    kinds = F.array(*[F.lit(k) for k in (
        "typedef", "function", "class", "member", "macro", "enum", "struct", "namespace", "prototype", "variable")])
    listing = standins.files(spark, folder).select("doc_id", "file").hint("shuffle_hash")
    texts = standins.files(spark, folder).select("doc_id", "text")
    # A fixed number of parts: those of a few MB of text hold many names, which adaptive execution cannot see.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    return first_lines(texts.repartition(parts, "doc_id")).join(listing, "doc_id").select(
        "name", "file", "line",
        kinds[F.pmod("doc_id", F.lit(10)).cast("int")].alias("kind"),
    )
