"""Every query that has SQL gives the same rows as DuckDB, on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from corpusloom.plans import kept
from corpusloom.plans import queries as own
from corpusloom.plans import single

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = own.QUERIES | single.QUERIES | kept.QUERIES, own.ORACLE | single.ORACLE | kept.ORACLE


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 5)
    return v


def rows(found, columns, order):
    return sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.collect(), df.columns, sorted(columns)) == rows(result.fetchall(), columns, sorted(columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
