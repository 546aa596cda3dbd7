"""Views of the given tables that stand in for repositories, indexes, histories and runs.

Every view is a plain column expression over a whole table, so its size follows
the table and the same rule can be written in SQL for checking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.text import split_lines
from treeline.session import spread
from treeline.sources.tables import table

def files(spark: SparkSession, folder: str) -> DataFrame:
    """documents as files: doc_id, source, lang, file, text."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "source", "lang", "text"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.withColumn("file", F.concat_ws("/", "source", "lang", name))


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """documents turned into source code whose comments open, close and run across lines."""
    return files(spark, folder).withColumn("text", code_text(F.col("text"), F.col("source")))


def code_text(text: Column, source: Column) -> Column:
    def render(line: Column, i: Column) -> Column:
        word = F.regexp_extract(line, "[A-Za-z]+", 0)
        shape = F.pmod(i + 1, F.lit(5))
        return (
            F.when(shape == 0, F.concat(F.lit('#include "'), source, F.lit("/"), word, F.lit('.h"')))
            .when(shape == 1, F.concat(F.lit("// #include <"), word, F.lit(".h>")))
            .when(shape == 2, F.concat(F.lit("/* "), word))
            .when(shape == 3, F.concat(F.lit("#include <"), source, F.lit("\\"), word, F.lit(".h>")))
            .otherwise(F.concat(F.lit('*/ #include "'), word, F.lit('.h"')))
        )

    return F.array_join(F.transform(split_lines(text), render), "\n")


def modules(spark: SparkSession, folder: str) -> DataFrame:
    """The module catalog: one row per source."""
    return table(spark, folder, "documents").select(F.col("source").alias("module_path")).distinct()


def page_paths(spark: SparkSession, folder: str) -> DataFrame:
    """pages as file paths: page_id, path (no scheme, query, fragment or outer slash)."""
    return table(spark, folder, "pages").select(
        "page_id",
        F.rtrim(
            F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", ""), F.lit("/")
        ).alias("path"),
    )


def kind_of(name: Column) -> Column:
    """Symbol kind by spelling: all capitals, initial capital, anything else."""
    return (
        F.when(name.rlike("^[A-Z][A-Z0-9_]*$"), "macro")
        .when(name.rlike("^[A-Z]"), "class")
        .otherwise("member")
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """conversations as a message history with tool calls and tool replies."""
    call = F.concat_ws("_", F.lit("call"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    step = F.pmod("turn", F.lit(4))
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.when(step == 1, "assistant").when(step == 2, "tool").otherwise(F.col("role")).alias("role"),
        F.col("text").alias("content"),
        F.when(step == 1, F.concat(F.lit('{"id": "'), call, F.lit('"}'))).alias("tool_calls"),
        F.when(step == 2, call).alias("tool_call_id"),
        F.when(step == 2, "search_text").alias("name"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """events as evaluation runs."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("run_id"),
        F.col("user_id").alias("case_id"),
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "signup", "max_loops_exceeded")
        .otherwise("completed")
        .alias("status"),
        F.col("value").alias("duration_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.col("event_type").alias("scenario"),
    )
