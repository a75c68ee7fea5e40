"""Every registered query of the engine against its SQL in DuckDB."""

import math
from collections import Counter

import duckdb
import pytest

from strata.plans import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v if isinstance(v, (bool, int, str)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in core.SQL:
        assert got
        return
    want = duck.sql(core.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert Counter(tuple(map(plain, r)) for r in got) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
