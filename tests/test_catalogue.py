"""Every query with oracle SQL against DuckDB on the driver's tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tarnforge.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}" if abs(v) < 1e15 else "inf"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{v:.5g}" if abs(v) < 10**5 else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = duck.execute(ORACLES[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(plain(v) for v in r) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, name):
    first = QUERIES[name](spark, FOLDER).first()[0]
    assert 0 <= first <= 1 and (first > 0.5 or not name.startswith("ml"))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
