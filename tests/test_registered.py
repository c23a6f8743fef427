"""Every registered query against its SQL twin, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as registered
import check

FOLDER = os.environ.get("SKYSIFT_TEST_TABLES", "/root/testdata/sf0.001")
SLOW = {"gbt_rmse"}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in check.TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registered.core_queries() - SLOW))
def test_query_equals_twin(spark, db, name):
    assert check.compare(spark, db, name, FOLDER).startswith("ok")


def test_every_query_but_training_has_a_twin():
    assert registered.core_queries() - set(registered.oracle_sql()) == SLOW
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry(spark):
    assert registered.entry(spark).count() > 900
