"""The registered queries against DuckDB on the smallest given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
OWN = {query.__name__ for query in entry_points.registered.REGISTERED}
SQL = {name: sql for name, sql in entry_points.oracle_sql().items() if name in OWN}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("documents", "conversations", "benchmark", "labels"):
        connection.sql(f"CREATE VIEW {table} AS FROM '{FOLDER}/{table}.parquet'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, (tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in frame.values.tolist())))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    ours = entry_points.queries()[name](spark, FOLDER).toPandas()
    theirs = duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_only_the_fit_has_no_sql():
    assert OWN - set(SQL) == {"train_classifier"}


def test_training_runs(spark):
    metrics = entry_points.queries()["train_classifier"](spark, FOLDER).collect()
    assert len(metrics) == 1 and metrics[0].accuracy >= 0.7


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
