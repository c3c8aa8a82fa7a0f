"""Registered queries against their SQL at the smallest scale."""

import glob
import os

import duckdb
import pytest

from batchtide.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return None if v is None or v != v else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    d = QUERIES[name](spark, SF)
    got = [tuple(map(plain, r)) for r in d.select(*sorted(d.columns)).collect()]
    spark.catalog.clearCache()
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(d.columns)
    at = [names.index(c) for c in sorted(names)]
    want = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-6) if all(isinstance(x, (int, float)) for x in (*a, *b)) else a == b
