"""Every query with SQL gives DuckDB's rows on the smallest tables, under a foreign session zone."""

import math
import os

import duckdb
import pytest

from tidemark.plans.oracle import ORACLE
from tidemark.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ("",)
    if isinstance(value, bool):
        return ("b", value)
    return ("n", float(value)) if isinstance(value, int | float) else ("s", str(value))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    rel = duck.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert mine == sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
