"""A Spark data source for SQLite files: format("loomwork_sqlite") with options path, query and, for parallel reads, key, low, high, parts; chunk is the number of rows fetched at a time."""

from __future__ import annotations

import sqlite3

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomwork_sqlite"

    def schema(self) -> str:
        with sqlite3.connect(self.options["path"]) as c:
            cur = c.execute(f"SELECT * FROM ({self.options['query']}) LIMIT 100")
            names, rows = [d[0] for d in cur.description], cur.fetchall()
        kinds = []
        for k in range(len(names)):
            found = {type(r[k]) for r in rows if r[k] is not None}
            kinds.append("bigint" if found == {int} else "double" if found and found <= {int, float} else "binary" if found == {bytes} else "string")
        return ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))

    def reader(self, schema):
        return SqliteReader(self.options, len(schema))


class SqliteReader(DataSourceReader):
    def __init__(self, options, width):
        self.options, self.width = dict(options), width

    def partitions(self):
        o = self.options
        if "key" not in o:
            return [InputPartition("")]
        low, high, n = int(o["low"]), int(o["high"]), int(o.get("parts", 4))
        step = max(1, -(-(high - low) // n))
        cuts = list(range(low + step, high, step))
        edges = [None, *cuts, None]
        ranges = [" AND ".join(x for x in (f"{o['key']} >= {a}" if a is not None else "", f"{o['key']} < {b}" if b is not None else "") if x) for a, b in zip(edges, edges[1:])]
        if len(ranges) > 1:
            ranges[0] = f"({ranges[0]} OR {o['key']} IS NULL)"
        return [InputPartition(x) for x in ranges]

    def read(self, partition):
        where = f" WHERE {partition.value}" if partition.value else ""
        with sqlite3.connect(self.options["path"]) as c:
            c = c.execute(f"SELECT * FROM ({self.options['query']}){where}")
            while rows := c.fetchmany(int(self.options.get("chunk", 10_000))):
                yield from rows


def scan_sqlite(spark: SparkSession, path: str, query: str, **options):
    spark.dataSource.register(SqliteSource)
    return spark.read.format("loomwork_sqlite").options(path=path, query=query, **options).load()
