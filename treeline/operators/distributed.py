"""Building blocks that keep one hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 16
BROADCAST_ROWS = 20_000


def salted_join(
    facts: DataFrame, keyed: DataFrame, on: str, spread_by: list[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Equi-join whose fact rows of one key are spread over `salts` tasks.

    `keyed` is repeated once per salt, so every fact row still meets every
    matching row exactly once.
    """
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, "_salt"], how).drop("_salt")


def lookup_join(
    facts: DataFrame, keyed: DataFrame, on: str, spread_by: list[str], bound: int = BROADCAST_ROWS
) -> DataFrame:
    """Join wide fact rows with a table that is expected, but not known, to be small.

    Its rows are counted first, up to the bound: within it the table is broadcast
    and the facts stay where they are; beyond it the join is salted.
    """
    if keyed.limit(bound + 1).count() <= bound:
        return facts.join(F.broadcast(keyed), on)
    return salted_join(facts, keyed, on, spread_by)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first `n` rows of each key; ranks past `n` are dropped before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def top_ranked(df: DataFrame, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """Global top `n` with a 1-based rank; only the `n` survivors meet in one task."""
    window = W.partitionBy(F.lit(0)).orderBy(*order)
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(window))


RANK_BUCKETS = 128


def exact_percentiles(df: DataFrame, value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated percentiles in one row, by selection of ranks.

    A sketch cuts the values into RANK_BUCKETS ranges of about equal mass; its error only moves
    the cuts. Distinct values are counted, running counts go over the values of one range, and the
    exact sizes of the ranges before it (RANK_BUCKETS rows) turn them into ranks, among which the
    two wanted ones of each percentile are picked. No row and no task holds more than a range.
    """
    cuts = F.array(*(F.lit(i / RANK_BUCKETS) for i in range(1, RANK_BUCKETS)))
    values = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    edges = values.agg(F.percentile_approx("v", cuts, 10_000).alias("edges"))
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).withColumn("edges", edges.scalar())
    # Never null, and said to be: a test for null on the join key would be pushed below the count, where
    # the expression behind the value is worked out anew for each edge of each row.
    bucket = F.coalesce(F.size(F.filter("edges", lambda e: e <= F.col("v"))), F.lit(0))
    counted = counted.select("v", "c", bucket.alias("bucket"))
    sizes = counted.groupBy("bucket").agg(F.sum("c").alias("size"))
    # One row a range.
    all_before = W.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    sizes = sizes.select(
        "bucket", F.coalesce(F.sum("size").over(all_before), F.lit(0)).alias("before"), F.sum("size").over(every).alias("n")
    )
    running = F.sum("c").over(W.partitionBy("bucket").orderBy("v"))
    ranked = counted.withColumn("upto", running).join(F.broadcast(sizes), "bucket")
    end = F.col("before") + F.col("upto")
    ranked = ranked.select("v", "n", (end - F.col("c")).alias("start"), end.alias("end"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("start") <= rank) & (rank < F.col("end")), F.col("v")))

    parts = [F.max("n").alias("n")]
    for name, p in probabilities.items():
        lower = F.floor((F.col("n") - 1) * F.lit(p))
        parts += [at(lower).alias(f"low_{name}"), at(F.least(lower + 1, F.col("n") - 1)).alias(f"high_{name}")]
    row = ranked.agg(*parts)

    def between(name: str, p: float) -> Column:
        position = (F.col("n") - 1) * F.lit(p)
        low, high = F.col(f"low_{name}"), F.col(f"high_{name}")
        return low + (high - low) * (position - F.floor(position))

    return row.select(*(between(name, p).alias(name) for name, p in probabilities.items()))
