"""Every registered query against its SQL twin on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "part documents embeddings pages events benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    found = entry.queries()[name](spark, FOLDER)
    result = sql.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    expected = table(columns, result.fetchall())
    got = table(found.columns, [tuple(r) for r in found.collect()])
    assert got[0] == expected[0]
    assert [tuple(map(str, r)) for r in got[1]] == [tuple(map(str, r)) for r in expected[1]] or got == expected


def test_what_has_no_twin_is_tested_by_brute_force():
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert all(name == "pipeline" or name.startswith("op") for name in without) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
