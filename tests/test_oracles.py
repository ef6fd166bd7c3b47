"""Every core query with SQL gives the same rows as DuckDB on the same tables."""

import glob
import math
from decimal import Decimal

import duckdb
import pytest

from assetlens.plans.queries import ORACLES, QUERIES


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return f"{float(v):.5f}".replace("-0.00000", "0.00000")
    return str(v)


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {f.rsplit('/', 1)[1].split('.')[0]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, data, db, name):
    got = QUERIES[name](spark, data)
    r = db.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(plain(dict(zip(names, row))[c]) for c in sorted(names)) for row in r.fetchall())
    have = sorted(tuple(plain(row[c]) for c in sorted(names)) for row in got.collect())
    assert have == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
