"""Shrinking oversized tool results to a character cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline import settings
from treeline.functions.jsonsize import string_size

# The cut marker and the least number of characters a cut content keeps.
CUT_MARKER = "\n... <truncated>"
LEAST_CONTENT = 200


def _flag_growth(present: Column) -> Column:
    """Characters added by `truncated: true`; an existing value of known size is replaced."""
    return F.when(present.isNull(), F.lit(len(', "truncated": true'))).otherwise(4 - present)


def compact_lists(
    results: DataFrame, list_key: str, cap: Column | int = settings.MAX_RESULT_CHARS
) -> DataFrame:
    """Halve the list of each result until its JSON text fits.

    Needs `head_size` (text with an empty list), `flag_size` (characters of an
    existing `truncated` value, NULL when absent) and `item_sizes`. Adds
    full_size, kept, omitted, final_size and outcome (unchanged/shrunk/stub).
    """
    cap = F.lit(cap) if isinstance(cap, int) else cap
    n = F.size("item_sizes")

    def with_items(head: Column, k: Column) -> Column:
        inner = F.aggregate(F.slice("item_sizes", F.lit(1), k), F.lit(0), lambda acc, x: acc + x)
        return head + inner + F.greatest(k - 1, F.lit(0)) * 2

    grown = F.col("head_size") + _flag_growth(F.col("flag_size"))
    halvings = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)))), F.lit(0)).cast("int")),
        lambda j: F.floor(n / F.pow(F.lit(2), j)).cast("int"),
    )
    kept = F.coalesce(
        F.get(F.filter(halvings, lambda k: with_items(grown, k) <= cap), F.lit(0)), F.least(n, F.lit(1))
    )
    sized = results.withColumn("full_size", with_items(F.col("head_size"), n)).withColumn("_kept", kept)
    omitted = n - F.col("_kept")
    note = F.when(n > 0, len(f', "{list_key}_omitted": ') + F.length(omitted.cast("string"))).otherwise(0)
    shrunk = with_items(grown, F.col("_kept")) + note
    fits = F.col("full_size") <= cap
    return sized.select(
        *results.columns,
        "full_size",
        F.when(fits, n).otherwise(F.col("_kept")).alias("kept"),
        F.when(fits, F.lit(0)).otherwise(omitted).alias("omitted"),
        F.when(fits, F.col("full_size")).otherwise(shrunk).alias("final_size"),
        F.when(fits, "unchanged").when(shrunk <= cap, "shrunk").otherwise("stub").alias("outcome"),
    )


def compact_content(results: DataFrame, cap: int = settings.MAX_RESULT_CHARS) -> DataFrame:
    """Cut the `content` of results without lists; columns as in `compact_lists` plus compacted content.

    Needs `head_size` (text with an empty content), `flag_size` and `content`.
    """
    keep = max(LEAST_CONTENT, cap // 4)
    cut = F.concat(F.substring("content", 1, keep), F.lit(CUT_MARKER))
    full = F.col("head_size") - 2 + string_size(F.col("content"))
    grown = full + _flag_growth(F.col("flag_size"))
    shrunk = (
        F.col("head_size") - 2 + _flag_growth(F.col("flag_size")) + string_size(cut)
        + len(', "content_truncated": true')
    )
    return results.select(
        *[c for c in results.columns if c != "content"],
        full.alias("full_size"),
        F.when(full <= cap, full).when(grown <= cap, grown).otherwise(shrunk).alias("final_size"),
        F.when(full <= cap, "unchanged").when(grown <= cap, "flagged").when(shrunk <= cap, "cut")
        .otherwise("stub").alias("outcome"),
        F.when((full <= cap) | (grown <= cap), F.col("content")).when(shrunk <= cap, cut).alias("content"),
    )
