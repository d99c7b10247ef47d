"""The registered queries against their SQL, and that none of their tables is cut."""

import duckdb

from loomwork.llm import queries

DATA = "/root/testdata/sf0.001"


def test_queries_equal_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, DATA)
        found = c.sql(sql)
        at = [found.columns.index(x) for x in df.columns]
        assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in found.fetchall()), name


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))
