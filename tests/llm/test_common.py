"""The join that spreads hot keys: its result, and that its plan deals rows out by more than the key."""

import pytest
from pyspark.sql import functions as F

from treeline.llm import common


@pytest.mark.parametrize("on, hot", [("k", 1000), ("k", 1), (["k", "lang"], 2)])
def test_same_as_a_left_join(spark, monkeypatch, on, hot):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rows = [(i, i % 5 if i % 3 else None, "en" if i % 2 else "de") for i in range(60)]
    big = spark.createDataFrame(rows, "row int, k int, lang string")
    keys = [on] if isinstance(on, str) else on
    small = big.filter("k < 4").groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.max("row").alias("most"))
    got = common.attach(big, small, on, "rows", ["row"])
    assert got.columns == ["row", "k", "lang", "most"]
    want = big.join(small.drop("rows"), keys, "left").select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_rows_of_hot_keys_are_dealt_out_in_the_plan(spark):
    big = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.max("id").alias("most"))
    plan = common.attach(big, small, "k", "rows", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "_spread#" in plan.split("SortMergeJoin [", 1)[1].split("\n", 1)[0]
    exchanges = [line for line in plan.splitlines() if "hashpartitioning(k#" in line and "_spread#" in line]
    assert exchanges, plan
