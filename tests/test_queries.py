"""Every registered query against its SQL twin in DuckDB, and the shape of the twinless ones."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
QUERIES, TWINS = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def text(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_matches_sql_twin(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    columns = sorted(frame.columns)
    found = sorted(tuple(map(text, row)) for row in frame.select(*columns).collect())
    result = duck.execute(TWINS[name])
    names = [entry[0] for entry in result.description]
    assert sorted(names) == columns
    order = [names.index(column) for column in columns]
    expected = sorted(tuple(text(row[i]) for i in order) for row in result.fetchall())
    assert found == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_runs_without_twin(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
