"""Every registered query against its SQL on another engine, at the small scale."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from playmetry.plans import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return repr(value) if math.isfinite(value) else str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return f"{type(value).__name__}:{value}"


def table(arrow):
    names = sorted(arrow.column_names)
    columns = [[plain(v) for v in arrow.column(n).to_pylist()] for n in names]
    return names, sorted(zip(*columns))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf):
    got = table(QUERIES[name](spark, sf).toArrow())
    if name not in ORACLES:
        assert got[1], f"{name} gives no rows"
        return
    want = table(duck.execute(ORACLES[name]).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_no_stray_sql():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert len(ORACLES) > 150


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
