"""Every catalog query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomwork.plans.catalog import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in ORACLE:
        assert rows
        return
    found = duck.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    want = sorted((tuple(value(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(value(r[c]) for c in cols) for r in rows), key=repr) == want
