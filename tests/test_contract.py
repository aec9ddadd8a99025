"""Driver contract and oracle parity on the smallest data set."""

import math

import duckdb
import pytest

from conftest import SF0001
import __spark_entry__ as E

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "user_id" and "net_roi" in df.columns


def test_oracles_are_registered_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 90


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF0001}/{t}.parquet')")
    return c


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def n(v):
        if isinstance(v, float) and math.isnan(v):
            return None
        return tuple(v) if isinstance(v, list) else v
    out = [tuple(n(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_parity_sf0001(spark, con, name):
    sdf = E.queries()[name](spark, SF0001)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert _norm(srows, sdf.columns) == _norm(orows, ocols)
