"""Stored vectors, searched exactly with few rows read, by the triangle inequality.

Vectors are stored by the pivot nearest to them, in order of their distance to it. A question's
distance to a pivot and the least and largest distance in the pivot's cell bound how near any
vector of the cell can be. The nearest cells are read first; the k-th distance found is a radius,
and then only rows are read whose own distance to their pivot can lie within it. What is skipped
cannot be among the k nearest, so the answer is that of a full scan, ties included.

Pivots are at most PIVOTS vectors, chosen by a hash; they are what tasks and the driver hold.
New vectors join the cells of the stored pivots; replaced ones are masked by their keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline import settings
from treeline.operators.distributed import first_per_key
from treeline.operators.retrieval import squared_distance
from treeline.sources.segments import GONE, Segments, open_store

KEY = ["kind", "doc_id"]
PIVOTS = 1024
#: Distances are rounded sums; a bound gives way by this share of what was added.
SLACK = 1e-9


def in_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """kind, doc_id, embedding, cell (number of the nearest pivot) and dist (distance to it)."""
    held = vectors.sparkSession.sparkContext.broadcast(pivots)
    rows = vectors.select(*KEY, "embedding")
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = held.value
        squares = (points * points).sum(axis=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = flat.reshape(part.num_rows, -1)
                cell = (squares[None, :] - 2 * (x @ points.T)).argmin(axis=1)
                gaps = x - points[cell]
                columns = [*part.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt((gaps * gaps).sum(axis=1)))]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell", "dist"])

    return rows.mapInArrow(run, schema)


@dataclass
class VectorIndex:
    """Stored vectors at one version of their store."""

    store: Segments

    def pivots(self) -> np.ndarray:
        rows = self.store.last("pivots").orderBy("cell").collect()
        return np.array([r.center for r in rows], np.float64)

    def vectors(self) -> DataFrame:
        return self.store.read("vectors")

    def _gap(self, query: list[float]) -> DataFrame:
        """cell and gap, the question's distance to each pivot."""
        points = self.pivots().reshape(-1, len(query)) - np.array(query, np.float64)
        gaps = np.sqrt((points * points).sum(axis=1))
        return self.store.spark.createDataFrame([(i, float(g)) for i, g in enumerate(gaps)], "cell int, gap double")

    def reach(self, query: list[float], k: int = settings.PER_SIDE) -> DataFrame:
        """kind, cell, low, high: between which distances to their pivot rows can be among the k nearest."""
        cells = self.store.read("cells", merged=False).groupBy("kind", "cell").agg(
            F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")
        )
        # A row for each kind and pivot at most.
        cells = cells.join(F.broadcast(self._gap(query)), "cell")
        near = F.greatest(F.lit(0.0), F.col("gap") - F.col("most"), F.col("least") - F.col("gap"))
        listed = sorted(cells.withColumn("near", near).collect(), key=lambda r: (r.kind, r.near, r.cell))
        dead = 0 if self.store.removed() is None else self.store.removed().count()
        first, have = [], {}
        for r in listed:
            # Masked rows may hide in any cell, so they come on top of the k rows wanted.
            if have.get(r.kind, 0) < k + dead:
                have[r.kind] = have.get(r.kind, 0) + r.n
                first.append((r.kind, r.cell, r.least, r.most))
        schema = "kind string, cell int, low double, high double"
        tried = self._within(self.store.spark.createDataFrame(first, schema), query, k)
        radius = {r.kind: r.distance for r in tried.filter(F.col("rank") == k).collect()}
        out = []
        for r in listed:
            limit = math.sqrt(radius[r.kind]) if r.kind in radius else math.inf
            limit += SLACK * (1 + limit + r.gap)
            if r.near <= limit:
                out.append((r.kind, r.cell, r.gap - limit, r.gap + limit))
        return self.store.spark.createDataFrame(out, schema)

    def _rows(self, reach: DataFrame) -> DataFrame:
        cells = [r.cell for r in reach.select("cell").distinct().collect()]
        rows = self.store.read("vectors", merged=False).filter(F.col("cell").isin(cells))
        # A row for each kind and pivot at most.
        rows = rows.join(F.broadcast(reach), ["kind", "cell"]).filter(F.col("dist").between(F.col("low"), F.col("high")))
        removed = self.store.removed()
        return rows if removed is None else self.store.without(rows, removed)

    def _within(self, reach: DataFrame, query: list[float], k: int) -> DataFrame:
        scored = self._rows(reach).select(*KEY, squared_distance(F.col("embedding"), query).alias("distance"))
        return first_per_key(scored, ["kind"], [F.asc("distance"), F.asc("doc_id")], k)

    def nearest(self, query: list[float], k: int = settings.PER_SIDE) -> DataFrame:
        """The k nearest vectors of each kind: kind, doc_id, (squared) distance, rank."""
        return self._within(self.reach(query, k), query, k)

    def read_report(self, query: list[float], k: int = settings.PER_SIDE) -> DataFrame:
        """kind, rows stored and rows whose distance had to be computed."""
        total = self.vectors().groupBy("kind").agg(F.count(F.lit(1)).alias("stored"))
        read = self._rows(self.reach(query, k)).groupBy("kind").agg(F.count(F.lit(1)).alias("computed"))
        return total.join(read, "kind", "left").fillna(0, ["computed"])

    def upsert(self, vectors: DataFrame) -> VectorIndex:
        """The store with these vectors in place of any of the same kind and id."""
        draft = self.store.draft()
        rows = _put(draft, in_cells(vectors, self.pivots()))
        draft.put(GONE, rows.select(*KEY))
        return VectorIndex(draft.commit())


def _put(draft, rows: DataFrame) -> DataFrame:
    rows = draft.put("vectors", rows, "cell", "kind", "dist")
    bounds = (F.count(F.lit(1)).alias("n"), F.min("dist").alias("least"), F.max("dist").alias("most"))
    draft.put("cells", rows.groupBy("kind", "cell").agg(*bounds))
    return rows


def build_vectors(vectors: DataFrame, folder: str) -> VectorIndex:
    """Write vectors (kind, doc_id, embedding; all of one length) as a store with pivots of its own."""
    spark = vectors.sparkSession
    store = Segments(spark, folder, KEY)
    count = vectors.count()
    size = max(1, min(PIVOTS, math.isqrt(count)))
    chosen = vectors.orderBy(F.xxhash64(*KEY), *KEY).limit(size).select(F.col("embedding").cast("array<double>").alias("e")).collect()
    points = np.array([r.e for r in chosen], np.float64)
    draft = store.draft()
    draft.put("pivots", spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "cell int, center array<double>"))
    _put(draft, in_cells(vectors, points) if count else vectors.select(*KEY, "embedding", F.lit(0).alias("cell"), F.lit(0.0).alias("dist")))
    return VectorIndex(draft.commit(replace_all=True))


def open_vectors(spark: SparkSession, folder: str) -> VectorIndex | None:
    """The stored vectors, or None if there are none."""
    store = open_store(spark, folder, KEY)
    return VectorIndex(store) if store else None
