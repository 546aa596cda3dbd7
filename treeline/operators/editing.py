"""Guarded replacement, whole-file writes and unified diffs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.text import count_of


def guarded_replace(files: DataFrame, old: Column, new: Column, expected: Column) -> DataFrame:
    """Replace literal text only where it occurs exactly the expected number of times.

    Adds ok, occurrences, error and the updated text; a mismatch keeps the text.
    """
    counted = files.withColumn("occurrences", count_of(F.col("text"), old))
    ok = F.col("occurrences") == expected
    return counted.withColumns({
        "ok": ok,
        "text": F.when(ok, F.replace(F.col("text"), old, new)).otherwise(F.col("text")),
        "error": F.when(~ok, F.format_string(
            "expected_occurrences=%d, actual_occurrences=%d", expected, F.col("occurrences"))),
    })


def plan_writes(existing: DataFrame, writes: DataFrame) -> DataFrame:
    """Outcome of whole-file writes: file, ok, created, overwritten, characters_written.

    existing: file; writes: file, content, overwrite.
    """
    known = existing.select("file").distinct().withColumn("_known", F.lit(True))
    there = F.coalesce("_known", F.lit(False))
    joined = writes.join(known, "file", "left").withColumn("ok", ~there | F.col("overwrite"))
    return joined.select(
        "file", "ok",
        (F.col("ok") & ~there).alias("created"),
        (F.col("ok") & there).alias("overwritten"),
        F.when(F.col("ok"), F.length("content")).alias("characters_written"),
    )


def unified_diffs(pairs: DataFrame) -> DataFrame:
    """Unified diff of `before` and `after` per file, computed batch-wise where the rows are."""

    def diffs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import difflib

        for batch in batches:
            texts = [
                "\n".join(difflib.unified_diff(
                    (before or "").splitlines(), (after or "").splitlines(),
                    fromfile=f"a/{name}", tofile=f"b/{name}", lineterm="",
                ))
                for name, before, after in zip(batch["file"], batch["before"], batch["after"])
            ]
            yield pd.DataFrame({"file": batch["file"], "diff": texts})

    return pairs.select("file", "before", "after").mapInPandas(diffs, "file string, diff string")
