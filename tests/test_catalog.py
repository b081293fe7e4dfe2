"""Every registered query against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from gritstone.plans.catalog import FLAGSHIP, ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(rows):
    def one(x):
        if isinstance(x, float):
            return None if math.isnan(x) else float(f"{x:.9g}")
        return x

    return [tuple(one(x) for x in r) for r in rows]


def same(a, b):
    if len(a) != len(b):
        return False
    key = lambda r: tuple((x is None, f"{x:.6g}" if isinstance(x, float) else str(x)) for x in r)
    for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        for u, v in zip(x, y, strict=True):
            if u != v and not (isinstance(u, int | float) and isinstance(v, int | float) and math.isclose(u, v, rel_tol=1e-6, abs_tol=1e-9)):
                return False
    return True


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = plain(df.select(*columns).collect())
    if name in ORACLE:
        got = duck.sql(ORACLE[name])
        assert sorted(got.columns) == columns
        assert same(rows, plain(got.select(", ".join(f'"{c}"' for c in columns)).fetchall()))


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert FLAGSHIP in e.queries() and e.entry(spark).count() > 0
    assert set(ORACLE) <= set(QUERIES) and set(e.oracle_sql()) <= set(e.queries())
