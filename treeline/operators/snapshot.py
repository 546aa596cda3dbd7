"""Content hashes of file trees and their comparison."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_tree(files: DataFrame, path: str = "file", content: str = "text") -> DataFrame:
    """Path and sha256 of every file except byte-code caches."""
    return files.filter(
        ~F.col(path).rlike(r"(?:^|/)__pycache__/") & ~F.col(path).rlike(r"\.py[co]$")
    ).select(F.col(path).alias("path"), F.sha2(F.col(content), 256).alias("sha256"))


def named_values(spark: SparkSession, values: dict[str, object]) -> DataFrame:
    """Snapshot entries of single values: commit, prompt, tool schema, dependency versions."""
    rows = [(name, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for name, v in values.items()]
    return spark.createDataFrame(rows, "path string, value string").select(
        "path", F.sha2("value", 256).alias("sha256")
    )


def head_commit(spark: SparkSession, root: str) -> str | None:
    """Commit a repository folder stands on, from its HEAD file; None when there is none."""
    def first_line(path: str) -> str | None:
        row = spark.read.format("binaryFile").load(path).select(F.col("content").cast("string")).head()
        return row[0].strip() if row else None

    try:
        head = first_line(f"{root}/.git/HEAD")
        return first_line(f"{root}/.git/{head[5:]}") if head and head.startswith("ref: ") else head
    except Exception:  # noqa: BLE001 - any unreadable repository simply has no commit
        return None


def capture(parts: dict[str, DataFrame]) -> DataFrame:
    """One snapshot out of named hash tables; entry paths are prefixed with the part's name."""
    out = None
    for name, part in parts.items():
        rows = part.select(F.concat(F.lit(f"{name}/"), "path").alias("path"), "sha256")
        out = rows if out is None else out.unionByName(rows)
    return out


def verify(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """Entries of a snapshot that are missing or differ now; new files are not reported."""
    now = current.select("path", F.col("sha256").alias("current"))
    return (
        snapshot.select("path", F.col("sha256").alias("expected"))
        .join(now, "path", "left")
        .filter(F.col("current").isNull() | (F.col("current") != F.col("expected")))
        .withColumn("issue", F.when(F.col("current").isNull(), "missing").otherwise("differs"))
    )


def signature(docs: DataFrame, *settings_: str) -> DataFrame:
    """One fingerprint of a corpus and the settings an index was built with.

    Row hashes are summed, so it needs no order and no single task ever sees the corpus.
    """
    row = F.xxhash64("doc_id", "kind", F.coalesce("module_path", F.lit("")), "part", "text")
    wide = [F.sum(F.pmod(F.shiftright(row, s), F.lit(1 << 20))) for s in (0, 20, 40)]
    return docs.agg(F.count(F.lit(1)).alias("rows"), *[w.alias(f"h{i}") for i, w in enumerate(wide)]).select(
        F.sha2(F.concat_ws("|", "rows", "h0", "h1", "h2", *[F.lit(s) for s in settings_]), 256).alias("signature")
    )
