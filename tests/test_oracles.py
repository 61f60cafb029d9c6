"""Every registered query beside its SQL, and rows of those that have none."""

import os

import duckdb
import pytest
from helixframe.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr([norm(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in ORACLES:
        assert got[1], name
        return
    r = con.execute(ORACLES[name])
    want = rows([d[0] for d in r.description], r.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1], (len(got[1]), len(want[1]), [x for x in got[1] if x not in set(want[1])][:3], [x for x in want[1] if x not in set(got[1])][:3])
