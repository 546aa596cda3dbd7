"""Repositories of files: recursive binary reads, encoding fallback, suffix filters."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline import settings
from treeline.functions.paths import in_skipped_directory, suffix

#: Bytes of content after which a batch of files is handed on.
BATCH_BYTES = 32 << 20


def _fallback(encodings: tuple[str, ...]):
    """A function of its own values only, so workers need not find this package."""

    def text(content: pd.Series) -> pd.Series:
        def read(raw):
            if raw is None:
                return None
            for name in encodings:
                try:
                    return bytes(raw).decode(name)
                except UnicodeDecodeError:
                    continue
            return None

        return content.map(read)

    return text


def decoded(content: Column) -> Column:
    """Text of a file: UTF-8 inside the JVM, the other encodings only for rows that need them.

    A leading byte-order mark is dropped and line ends become newlines.
    """
    utf8 = F.try_validate_utf8(content.cast("string"))
    fallback = F.pandas_udf(_fallback(tuple(settings.ENCODINGS)), "string")(F.when(utf8.isNull(), content))
    text = F.regexp_replace(F.coalesce(utf8, fallback), r"\A\ufeff", "")
    return F.regexp_replace(text, r"\r\n?", "\n")


def listed_files(
    spark: SparkSession, root: str, suffixes: tuple[str, ...] | None = None, prune: bool = True
) -> DataFrame:
    """All files below `root`, also those whose names start with `_` or `.`: file (relative path).

    Directories on the skip list are pruned unless `prune` is off; suffixes
    compare in lower case. Each directory at the top is listed by one task.
    """
    where = location(root)

    def listing(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = fs.FileSystem.from_uri(where)
            base = base.rstrip("/")
            for batch in batches:
                for start, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if not folder:
                        yield pa.RecordBatch.from_pydict({"file": [start], "folder": [False]})
                    ahead = [start] if folder else []
                    while ahead:
                        found = store.get_file_info(fs.FileSelector(f"{base}/{ahead.pop()}"))
                        kept = [i for i in found if i.type == fs.FileType.File or not deep]
                        ahead += [i.path[len(base) + 1 :] for i in found if deep and i.type == fs.FileType.Directory]
                        names = pa.array([i.path[len(base) + 1 :] for i in kept], pa.string())
                        folders = pa.array([i.type == fs.FileType.Directory for i in kept], pa.bool_())
                        yield pa.RecordBatch.from_arrays([names, folders], ["file", "folder"])

        return run

    schema = "file string, folder boolean"
    top = spark.range(0, 1, 1, 1).select(F.lit("").alias("file"), F.lit(True).alias("folder"))
    spread = _tasks(spark)
    files = top.mapInArrow(listing(False), schema)
    if prune:
        # A file below stands for what the directory holds, so the filter sees its name.
        files = files.filter(~in_skipped_directory(F.concat("file", F.lit("/_")), settings.SKIPPED_DIRECTORIES) | ~F.col("folder"))
    files = files.repartition(spread, "file").mapInArrow(listing(True), schema).select("file")
    if prune:
        files = files.filter(~in_skipped_directory(F.col("file"), settings.SKIPPED_DIRECTORIES))
    if suffixes:
        files = files.filter(suffix(F.col("file")).isin(*suffixes))
    return files


def location(root: str) -> str:
    return root if root.split("/")[0].endswith(":") else os.path.abspath(root)


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def content_of(store: fs.FileSystem, path: str) -> bytes | None:
    """The bytes of a file; None if it is gone or forbidden. Other faults fail the task, which is retried."""
    try:
        with store.open_input_file(path) as file:
            return file.read()
    except (FileNotFoundError, PermissionError):
        return None


def read_files(
    spark: SparkSession, root: str, suffixes: tuple[str, ...] | None = None, prune: bool = True
) -> DataFrame:
    """The files of `listed_files` with their bytes: file, content; missing or forbidden ones are dropped.

    `root` is a folder or a URI of a store that Arrow opens. Names are dealt out to
    tasks before any content is read, however the files lie in directories.
    """
    where, most = location(root), BATCH_BYTES

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(where)
        base = base.rstrip("/")

        def batch_of(names: list[str], contents: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["file", "content"])

        for batch in batches:
            names, contents, held = [], [], 0
            for name in batch.column(0).to_pylist():
                content = content_of(store, f"{base}/{name}")
                if content is None:
                    continue
                contents.append(content)
                names.append(name)
                held += len(contents[-1])
                if held >= most:
                    yield batch_of(names, contents)
                    names, contents, held = [], [], 0
            yield batch_of(names, contents)

    names = listed_files(spark, root, suffixes, prune).repartition(_tasks(spark), F.xxhash64("file"))
    return names.mapInArrow(read, "file string, content binary")


def read_texts(spark: SparkSession, root: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """Files with decoded text: file, text."""
    return read_files(spark, root, suffixes).select("file", decoded(F.col("content")).alias("text"))


def strict_texts(files: DataFrame) -> DataFrame:
    """Only the files whose content is valid UTF-8: file, text."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("file", text.alias("text")).filter("text IS NOT NULL")
