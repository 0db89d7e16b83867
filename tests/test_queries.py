"""Every query of lodestone.plans against DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from lodestone.plans import ALL

DATA = "/root/testdata/sf0.001"
QUERIES = {k: f for m in ALL for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in ALL for k, s in m.ORACLES.items()}


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, (float, decimal.Decimal, int)):
        return repr(round(float(v), 7) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return "[" + ",".join(norm(x) for x in v) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    r = duck.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(norm(row[i]) for i in at) for row in r.fetchall())
