"""Every registered query against its SQL, on the smallest data set."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("TREELINE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield con
    con.close()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    result = contract.queries()[name](spark, FOLDER)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    answer = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(result.columns) == sorted(columns)
    assert rows_of(result.columns, result.collect()) == rows_of(columns, answer.fetchall())


def test_every_query_without_sql_is_meant_to_have_none():
    corpus = {n for n in contract.queries() if n.startswith("op") or n == "pipeline"}
    assert set(contract.queries()) - set(contract.oracle_sql()) <= corpus


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
