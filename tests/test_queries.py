"""Every query against its SQL on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)) or (isinstance(v, int) and abs(v) < 10**8):
        return "nan" if math.isnan(float(v)) else f"{float(v) + 0.0:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in ORACLES:
        return
    r = duck.execute(ORACLES[name])
    columns = [c[0] for c in r.description]
    expected = r.fetchall()
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted(tuple(plain(x[c]) for c in order) for x in rows)
    assert got == sorted(tuple(plain(x[columns.index(c)]) for c in order) for x in expected)


def test_every_oracle_has_a_query_and_entry_runs(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert entry.entry(spark).columns == ["boundary_release", "record_kind", "record_key", "change_kind"]
