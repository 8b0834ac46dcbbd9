"""Every vector query with SQL against DuckDB on the smallest tables."""

import os

import pandas as pd
import pytest

from quarry import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda x: "null" if x is None or x is pd.NA or x != x else str(x) if isinstance(x, (str, bool)) or type(x).__name__ == "bool" else repr(float(x))
    return list(frame.columns), sorted(tuple(map(text, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, name):
    ours = plain(queries.QUERIES[name](spark, FOLDER).toPandas())
    assert ours == plain(duck.execute(queries.ORACLES[name]).df())


def test_graph_search_finds_most(spark):
    sweep = queries.QUERIES["hnsw_sweep"](spark, FOLDER).orderBy("ef").collect()
    recalls = [r["recall"] for r in sweep]
    assert recalls == sorted(recalls) and recalls[-1] >= 0.95
    assert queries.QUERIES["hnsw_search"](spark, FOLDER).count() == 100


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries.QUERIES["filtered_knn"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "label" in plan.split("PushedFilters")[1].split("]")[0]
    assert "WindowGroupLimit" in plan
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
