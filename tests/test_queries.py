"""Every query that SQL can express, against DuckDB on the small tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402

TABLES = ("documents", "labels", "embeddings", "events")


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return 0.0 if value == 0 else float(f"{value:.9g}")
    return value


def canonical(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    df = contract.queries()[name](spark, sf)
    columns = sorted(df.columns)
    result = duck.execute(contract.oracle_sql()[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    theirs = [tuple(r[order.index(c)] for c in columns) for r in result.fetchall()]
    ours = [tuple(r) for r in df.select(*columns).collect()]
    assert len(ours) == len(theirs)
    for a, b in zip(canonical(ours), canonical(theirs)):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6)
            else:
                assert x == y


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert {r.language for r in rows} == {"en", "es", "fr", "de"}
    assert len(rows) == 80


def test_every_check_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
