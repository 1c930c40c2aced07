"""Every query of the catalogue against its SQL in DuckDB on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from ledgerlark.plans import catalogue

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(DATA + "/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows_of(names, rows, cols):
    at = [names.index(c) for c in cols]
    return sorted((tuple(value(r[i]) for i in at) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, abs=2e-5)
    return a == b


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()], sorted(df.columns))
    if name not in catalogue.oracle_sql():
        assert got is not None
        return
    r = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = rows_of(names, r.fetchall(), sorted(df.columns))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(map(close, a, b)), (a, b)


def test_entry_works_without_the_text_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(e.queries())
