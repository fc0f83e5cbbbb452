"""Every query with a SQL counterpart against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

from .conftest import SF_DIR

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, int):
        return round(float(v), 4)
    return float(v) if type(v).__name__ == "Decimal" else v


def bag(rows):
    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = entry_point.queries()[name](spark, SF_DIR)
    cursor = con.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    got, want = bag(df.select(*[df[c] for c in order]).collect()), bag(tuple(r[i] for i in at) for r in want)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-4) for a, b in zip(g, w)), (g, w)


def test_names_agree():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
