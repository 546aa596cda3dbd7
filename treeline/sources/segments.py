"""Tables that change by segments: a log of commits, read merged, changed under optimistic locks.

A store is a folder with a log of numbered commit files and a folder of data per segment. Each
segment holds rows of some tables and, in `gone`, the keys whose rows of earlier segments no longer
count: replaced or removed ones. Reading merges the segments by an anti join with those keys, so
a change costs what it touches. A commit names the version it was made from; if another one came
first, it is refused and nothing of it is ever visible. Data are written before the commit, by
tasks that may fail and be repeated; a lost driver leaves unreferenced folders only. The last
step is a rename that the file system must refuse if its target exists, as shared ones do.

The log lists segments, not rows: some bytes each. Callers fold segments into one by a commit
in place of all others.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GONE = "gone"


class Conflict(Exception):
    """The store has changed since the version a commit was made from."""


class Segments:
    """A store of segments at one of its versions; version 0 is the empty store."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], version: int | None = None) -> None:
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.version = self.latest() if version is None else version
        self.segments: list[dict] = self._entry(self.version) if self.version else []

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> int:
        path, files = self._path("")
        if not files.exists(path):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _entry(self, version: int) -> list[dict]:
        row = self.spark.read.text(f"{self.folder}/log/{version:012d}.json", wholetext=True).head()
        return json.loads(row[0])["segments"]

    def refreshed(self) -> Segments:
        return Segments(self.spark, self.folder, self.key)

    def _tables(self, name: str) -> list[tuple[int, DataFrame]]:
        return [
            (i, self.spark.read.parquet(f"{self.folder}/{s['folder']}/{name}"))
            for i, s in enumerate(self.segments)
            if name in s["tables"]
        ]

    def removed(self) -> DataFrame | None:
        """Each key that some segment takes from the earlier ones, and the last segment that does."""
        parts = [df.select(*self.key, F.lit(i).alias("_gone_at")) for i, df in self._tables(GONE)]
        if not parts:
            return None
        return reduce(DataFrame.unionByName, parts).groupBy(*self.key).agg(F.max("_gone_at").alias("_gone_at"))

    def read(self, name: str, merged: bool = True) -> DataFrame:
        """The rows of a table at this version; with `merged` off those of all segments, and `segment`."""
        parts = self._tables(name)
        if not parts:
            raise KeyError(f"{self.folder} has no table {name} at version {self.version}")
        rows = reduce(
            lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("segment", F.lit(i)) for i, df in parts)
        )
        if not merged:
            return rows
        removed = self.removed()
        if removed is not None:
            rows = self.without(rows, removed)
        return rows.drop("segment")

    def without(self, rows: DataFrame, removed: DataFrame) -> DataFrame:
        """Rows (with their `segment`) whose key no later segment has taken."""
        named = removed.select(*(F.col(k).alias(f"_{k}") for k in self.key), "_gone_at")
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.key))
        return rows.join(named, same & (F.col("segment") < F.col("_gone_at")), "left_anti")

    def last(self, name: str) -> DataFrame:
        """The newest segment's own rows of a table that each segment writes whole."""
        return self._tables(name)[-1][1]

    def draft(self) -> Draft:
        return Draft(self)

    def _log(self, segments: list[dict]) -> Segments:
        path, files = self._path(f"{self.version + 1:012d}.json")
        body = json.dumps({"segments": segments}).encode()
        if self.latest() != self.version:
            raise Conflict(f"{self.folder} is at version {self.latest()}, not {self.version}")
        # Written whole under another name; the rename fails if the version exists.
        draft, _ = self._path(f"draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(body)
        out.close()
        if files.exists(path) or not files.rename(draft, path):
            files.delete(draft, False)
            raise Conflict(f"{self.folder} has got version {self.version + 1} meanwhile")
        return Segments(self.spark, self.folder, self.key, self.version + 1)


class Draft:
    """A segment in the making: tables are written one by one and become visible by the commit."""

    def __init__(self, store: Segments) -> None:
        self.store, self.folder, self.tables = store, f"data/{uuid.uuid4().hex}", []

    def put(self, name: str, df: DataFrame, *order: str) -> DataFrame:
        """Write a table of the segment, in key order if one is given; returns the written rows."""
        if order:
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        path = f"{self.store.folder}/{self.folder}/{name}"
        df.write.parquet(path)
        self.tables.append(name)
        return self.store.spark.read.parquet(path)

    def commit(self, replace_all: bool = False) -> Segments:
        """Add the segment, or put it in place of all others; Conflict if the store has moved on."""
        segment = {"folder": self.folder, "tables": self.tables}
        return self.store._log([segment] if replace_all else [*self.store.segments, segment])


def open_store(spark: SparkSession, folder: str, key: list[str]) -> Segments | None:
    """The store in a folder, or None if there is none."""
    try:
        found = Segments(spark, folder, key)
    except AnalysisException:
        return None
    return found if found.version else None
