"""Helpers shared by the operators: shared folders, written tables, joins on hot keys."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Keys with the most rows that are joined by broadcast; the bound of every such broadcast.
HOT_KEYS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    A folder of its own is made only where none is named and everything runs in one
    machine (tests); a cluster without a named folder is refused.
    """
    context = spark.sparkContext
    named = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="treeline-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named if "://" in named or named.startswith("file:") else f"file://{named}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a table in the shared folder: computed once, kept if executors go."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def bind(value: Column, use) -> Column:
    """`use(value)` with the value computed once per row, however often lambdas inside read it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def indexes(first: Column | int, last: Column) -> Column:
    """The integers first..last; empty if last < first (a plain sequence would count down)."""
    start = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= start, F.sequence(start, last)).otherwise(F.array().cast("array<int>"))


def attach(big: DataFrame, small: DataFrame, on: str | list[str], count: str, spread: list[str]) -> DataFrame:
    """Left join of `big` with `small` (one row per key `on`, `count` = its rows in `big`).

    The HOT_KEYS most frequent keys come by broadcast and their rows are dealt out by the
    columns `spread`; all others meet in an ordinary shuffle join. The result is the same
    as that of a plain left join; null keys match nothing.
    """
    keys = [on] if isinstance(on, str) else on
    values = [c for c in small.columns if c not in (*keys, count)]
    same = lambda prefix: reduce(
        lambda a, b: a & b, (F.col(k) == F.col(f"{prefix}{i}") for i, k in enumerate(keys))
    )
    named = lambda prefix: [F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)]
    hot = small.orderBy(F.desc(count), *keys).limit(HOT_KEYS)
    hot = hot.select(*named("_hot"), F.struct(*values).alias("_hot_values"))
    # Always 0, but no literal: the optimizer would fold that and deal rows out by the key alone.
    cold_deal = F.when(F.col(count) < 0, 1).otherwise(0)
    cold = small.select(*named("_key"), cold_deal.alias("_deal"), F.struct(*values).alias("_values"))
    deal = F.pmod(F.xxhash64(*spread), F.lit(1 << 20)).cast("int") + 1
    unmatched = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    rows = big.join(F.broadcast(hot), same("_hot"), "left").withColumn(
        "_spread", F.when(F.col("_hot0").isNotNull() | unmatched, deal).otherwise(0)
    )
    rows = rows.join(cold.hint("merge"), same("_key") & (F.col("_spread") == F.col("_deal")), "left")
    found = F.coalesce("_hot_values", "_values")
    return rows.select(*big.columns, *(found[c].alias(c) for c in values))


def process_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, over all its tasks."""
    holder = sys.modules.setdefault("_treeline_process_store", types.ModuleType("_treeline_process_store"))
    return holder.__dict__.setdefault(name, {})
