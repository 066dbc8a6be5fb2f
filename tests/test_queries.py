"""Every query with SQL gives the SQL's rows, on the smallest tables."""

import duckdb
import pytest

from wattline.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query(spark, duck, key):
    frame = catalog.QUERIES[key](spark, DATA)
    got = rows(frame.columns, frame.collect())
    if key in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[key])
        assert sorted(frame.columns) == sorted(want.columns)
        assert got == rows(list(want.columns), want.fetchall())
    else:
        assert frame.columns
