"""Report tables in Markdown and exports of results as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(df: DataFrame, name: str) -> Column:
    """A value as table text: '-' when missing, numbers with fractions to three places."""
    kind = df.schema[name].dataType.simpleString()
    value = F.col(name)
    if kind in ("double", "float"):
        text = F.format_string("%.3f", value)
    elif kind.startswith("array<string"):
        text = F.array_join(value, ", ")
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(text)


def markdown_rows(df: DataFrame) -> DataFrame:
    """One `line` per row, in Markdown table form."""
    inner = F.concat_ws(" | ", *[cell(df, c) for c in df.columns])
    return df.select(F.concat(F.lit("| "), inner, F.lit(" |")).alias("line"))


def markdown_head(titles: list[str]) -> list[str]:
    return ["| " + " | ".join(titles) + " |", "| " + " | ".join("---" for _ in titles) + " |"]


def write_json(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).json(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
