"""Every query that has SQL against DuckDB on the smallest tables."""

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SMALL):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    return c


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 5)
    return tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = sql.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == Counter(repr([plain(r[k]) for k in at]) for r in found.fetchall())


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p7_found"} <= set(entry.queries())
