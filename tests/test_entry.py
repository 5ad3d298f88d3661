"""Every registered query against its SQL on the smallest tables, and the entry point."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from itemweave.plans import literals
from itemweave.plans import queries as core

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def compare(spark, name, query, sql):
    df = query(spark, SMALL)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, name):
    if name in core.SQL:
        compare(spark, name, core.QUERIES[name], core.SQL[name])
    else:
        assert core.QUERIES[name](spark, SMALL).count() >= 0


@pytest.mark.parametrize("name", sorted(literals.QUERIES))
def test_literal_query(spark, name):
    compare(spark, name, literals.QUERIES[name], literals.SQL[name])


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.items <= 10 for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())
