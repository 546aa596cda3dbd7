"""Connected components of a graph given as a table of edges between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import attach, written


def smallest_neighbours(edges: DataFrame) -> DataFrame:
    """u, low (its smallest neighbour or itself), degree."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in the edges (u, v); root is the smallest id it can reach.

    Alternates large-star and small-star rounds. Each is two aggregations with a join that
    spreads hot ids, written to the shared folder; the number of rounds is logarithmic.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    pairs = written(pairs, "edges")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = smallest_neighbours(both)
        large = attach(both, lows, "u", "degree", ["v"]).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = written(large.filter("u > v").distinct(), "large-star")
        lows = smallest_neighbours(large)
        tied = attach(large, lows, "u", "degree", ["v"])
        small = tied.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(tied.select("u", F.col("low").alias("v")))
        pairs = written(small.filter("u > v").distinct(), "small-star")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
