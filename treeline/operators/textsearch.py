"""Listing, finding and reading text over file tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline import settings
from treeline.functions.paths import base_name
from treeline.functions.text import split_lines
from treeline.operators.distributed import top_ranked


def _inside(path: Column, directory: str) -> Column:
    return F.lit(True) if directory in ("", ".") else path.startswith(directory.rstrip("/") + "/")


def list_directory(
    paths: DataFrame, directory: str = ".", path: str = "path", cap: int = settings.MAX_LIST_ITEMS
) -> DataFrame:
    """One directory level: rank, name, type, item_count (before the cap), truncated."""
    inside = paths.filter(_inside(F.col(path), directory))
    rest = F.col(path) if directory in ("", ".") else F.col(path).substr(
        F.lit(len(directory.rstrip("/")) + 2), F.length(path)
    )
    items = (
        inside.select(rest.alias("_rest"))
        .groupBy(F.substring_index("_rest", "/", 1).alias("name"))
        .agg(F.when(F.max(F.col("_rest").contains("/")), "dir").otherwise("file").alias("type"))
        .filter("name <> ''")
    )
    total = items.agg(F.count(F.lit(1))).scalar()
    shown = top_ranked(items, [F.lower("name").asc(), F.col("name").asc()], cap)
    return shown.select("rank", "name", "type", total.alias("item_count")).withColumn(
        "truncated", F.col("item_count") > cap
    )


def find_files(
    paths: DataFrame, name: str, directory: str = ".", path: str = "path", cap: int = settings.MAX_FILENAME_MATCHES
) -> DataFrame:
    """Files whose name contains `name` in any case, in path order, at most `cap`."""
    hits = paths.filter(_inside(F.col(path), directory)).filter(
        F.lower(base_name(F.col(path))).contains(name.lower())
    )
    return top_ranked(hits.select(path), [F.lower(path).asc(), F.col(path).asc()], cap)


def line_matches(files: DataFrame, query: str, path: str = "file", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every line containing `query`; files without a hit are not split into lines."""
    hits = F.filter(
        F.transform(
            split_lines(F.col("text")),
            lambda line, i: F.struct((i + 1).alias("line_number"), line.alias("line")),
        ),
        lambda row: row["line"].contains(query),
    )
    return (
        files.filter(F.col("text").contains(query))
        .select(*keep, F.col(path).alias("relative_path"), F.explode(hits).alias("_hit"))
        .select(*keep, "relative_path", "_hit.*")
    )


def search_text(
    files: DataFrame, query: str, directory: str, path: str = "file", cap: int = settings.MAX_SEARCH_MATCHES
) -> DataFrame:
    """Matching lines under a directory in path order: rank, relative_path, line_number, line, truncated."""
    if directory.strip() in ("", ".", "/"):
        raise ValueError("a whole-repository text search is not allowed; name a directory")
    order = [F.lower("relative_path").asc(), F.col("relative_path").asc(), F.col("line_number").asc()]
    shown = top_ranked(line_matches(files.filter(_inside(F.col(path), directory)), query, path), order, cap)
    return shown.withColumn("truncated", F.count(F.lit(1)).over(_all_rows()) >= cap)


def _all_rows():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def read_window(files: DataFrame, start: Column, end: Column) -> DataFrame:
    """Line window per file: swapped when reversed, clipped to 200 lines, clamped to the text."""
    first, last = F.least(start, end), F.greatest(start, end)
    cut = F.least(last, first + settings.MAX_READ_LINES - 1)
    total = F.col("total_lines")
    framed = files.withColumn("_lines", split_lines(F.col("text"))).withColumn(
        "total_lines", F.size("_lines")
    ).withColumns({
        "truncated": last - first + 1 > settings.MAX_READ_LINES,
        "start_line": F.when(total > 0, F.least(first, total)).otherwise(F.lit(1)).cast("int"),
        "end_line": F.when(total > 0, F.least(cut, total)).otherwise(F.lit(0)).cast("int"),
    })
    content = F.array_join(
        F.slice("_lines", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))),
        "\n",
    )
    return framed.withColumn("content", content).withColumn("characters_read", F.length("content")).drop(
        "_lines", "text"
    )


def read_preview(files: DataFrame) -> DataFrame:
    """Head of each file when no range is given."""
    lines = files.withColumn("_lines", split_lines(F.col("text"))).withColumn("total_lines", F.size("_lines"))
    end = F.least(F.col("total_lines"), F.lit(settings.PREVIEW_LINES))
    return (
        lines.withColumns({
            "start_line": F.when(F.col("total_lines") > 0, 1).otherwise(0),
            "end_line": end,
            "content": F.array_join(F.slice("_lines", F.lit(1), end), "\n"),
        })
        .withColumn("characters_read", F.length("content"))
        .drop("_lines", "text")
    )
