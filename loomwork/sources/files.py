"""Scans and sinks. Scans are lazy, sinks are distributed writes; only the functions that say so come to the driver."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..session import work_path

#: The mark that spreadsheet programs tell UTF-8 by.
BOM = "\ufeff"


def scan_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    r = spark.read.option("header", header).option("sep", sep).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_json(spark: SparkSession, path: str, schema: str | None = None, array: bool = False) -> DataFrame:
    r = spark.read.option("multiLine", array)
    return (r.schema(schema) if schema else r).json(path)


def scan_sql(spark: SparkSession, query: str, url: str | None = None, **options: Any) -> DataFrame:
    """A query over JDBC if a url is given, else over the session's views."""
    if url is None:
        return spark.sql(query)
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def _quoted(dialect: str, name: str) -> str:
    a, b = {"sqlserver": "[]", "mysql": "``"}.get(dialect, '""')
    return a + name.replace(b, b + b) + b


def sql_text(query: str, dialect: str = "generic", columns: list[str] | None = None, limit: int | None = None) -> str:
    """The query with its projection and row limit pushed into the text of a dialect: generic, postgresql, sqlite, mysql, sqlserver or oracle."""
    if dialect not in ("generic", "postgresql", "sqlite", "mysql", "sqlserver", "oracle"):
        raise ValueError(f"no dialect: {dialect!r}")
    query = query.strip().rstrip(";").rstrip()
    if columns is None and limit is None:
        return query
    wanted = ", ".join(_quoted(dialect, c) for c in columns) if columns else "*"
    top = f"TOP ({int(limit)}) " if dialect == "sqlserver" and limit is not None else ""
    last = "" if limit is None or top else f" FETCH FIRST {int(limit)} ROWS ONLY" if dialect == "oracle" else f" LIMIT {int(limit)}"
    return f"SELECT {top}{wanted} FROM ({query}){'' if dialect == 'oracle' else ' AS'} q{last}"


def read_sql(spark: SparkSession, query: str, dialect: str, source: str, columns: list[str] | None = None, limit: int | None = None, chunk: int = 10_000, **options: Any) -> DataFrame:
    """A query of a database: `source` is a JDBC url, or a file for sqlite. The executors fetch `chunk` rows at a time; options may split the read (see scan_sqlite, or JDBC's partitionColumn)."""
    text = sql_text(query, dialect, columns, limit)
    if dialect == "sqlite":
        from .sqlite import scan_sqlite

        return scan_sqlite(spark, source, text, chunk=chunk, **options)
    return scan_sql(spark, text, source, fetchsize=chunk, **options)


def from_rows(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def from_arrow(spark: SparkSession, table: pa.Table | pa.RecordBatch) -> DataFrame:
    return spark.createDataFrame(pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table)


def from_cursor(spark: SparkSession, cursor, schema: str, chunk: int = 10_000) -> DataFrame:
    """A DB-API cursor's rows: the driver holds one chunk at a time and appends it to a table in the shared folder."""
    path = work_path(spark, "cursor")
    spark.createDataFrame([], schema).write.parquet(path)
    while rows := cursor.fetchmany(chunk):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, bom: bool = False) -> None:
    """One file a partition; with `bom` each begins with a byte-order mark, in front of its header."""
    if bom:
        if not header:
            raise ValueError("a byte-order mark is written in front of the header")
        df = df.toDF(BOM + df.columns[0], *df.columns[1:])
    df.write.option("sep", sep).option("header", header).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_json(df: DataFrame, path: str, ndjson: bool = True) -> None:
    """A row a line, or, not ndjson, one JSON array a file (read by scan_json with array)."""
    if ndjson:
        df.write.option("ignoreNullFields", False).json(path)
        return

    def run(batches):
        mark = "["
        for b in batches:
            lines = [f"{',' if k or mark != '[' else mark}{x}" for k, x in enumerate(b.column(0).to_pylist())]
            if lines:
                mark = ","
                yield pa.RecordBatch.from_pydict({"value": lines})
        yield pa.RecordBatch.from_pydict({"value": ["]" if mark == "," else "[]"]})

    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(run, "value string").write.text(path)


def write_ipc(df: DataFrame, path: str, stream: bool = False) -> DataFrame:
    """One Arrow file (or stream) per partition in a folder that all executors share, batch by batch; returns file and rows of each."""
    def run(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is not None:
            store, folder = FileSystem.from_uri(path)
            store.create_dir(folder, recursive=True)
            name, rows = f"{folder}/{uuid.uuid4().hex}.{'arrows' if stream else 'arrow'}", first.num_rows
            with store.open_output_stream(name) as f, (pa.ipc.new_stream if stream else pa.ipc.new_file)(f, first.schema) as w:
                w.write_batch(first)
                for b in batches:
                    w.write_batch(b)
                    rows += b.num_rows
            yield pa.RecordBatch.from_pydict({"file": [name], "rows": [rows]})

    return df.mapInArrow(run, "file string, rows long")


def scan_ipc(spark: SparkSession, path: str) -> DataFrame:
    """Arrow files (.arrow) and streams (.arrows) of a folder, or one of them: a task a file, batch by batch. The schema is the first file's."""
    store, own = FileSystem.from_uri(path)
    found = store.get_file_info(own)
    names = [own] if found.type == FileType.File else sorted(f.path for f in store.get_file_info(FileSelector(own)) if f.path.endswith((".arrow", ".arrows")))
    if not names:
        raise FileNotFoundError(f"no Arrow files in {path}")

    def opened(name: str):
        fs, _ = FileSystem.from_uri(path)
        return fs.open_input_file(name), pa.ipc.open_stream if name.endswith(".arrows") else pa.ipc.open_file

    f, reader = opened(names[0])
    with f:
        schema = reader(f).schema

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                f, reader = opened(name)
                with f:
                    r = reader(f)
                    yield from r if name.endswith(".arrows") else map(r.get_batch, range(r.num_record_batches))

    listed = spark.createDataFrame([(n,) for n in names], "name string").repartition(min(len(names), 10_000))
    return listed.mapInArrow(run, from_arrow_schema(schema))


def to_arrow(df: DataFrame) -> pa.Table:
    """To the driver."""
    return df.toArrow()


def to_dict(df: DataFrame) -> dict[str, list]:
    """To the driver."""
    return df.toArrow().to_pydict()


def json_array(df: DataFrame, order_by: list[str]) -> DataFrame:
    """The whole frame as one JSON array: for small results."""
    rows = F.sort_array(F.collect_list(F.struct(F.struct(*order_by).alias("o"), F.struct(*df.columns).alias("r"))))
    return df.agg(F.to_json(F.transform(rows, lambda x: x["r"]), {"ignoreNullFields": "false"}).alias("json"))


def batches(df: DataFrame, size: int = 65_536) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `size` rows as they are ready, one partition at a time on the driver."""

    def packed(it):
        for b in it:
            for k in range(0, b.num_rows, size):
                yield pa.RecordBatch.from_pydict({"b": [b.slice(k, size).serialize().to_pybytes()]})

    schema = df.limit(0).toArrow().schema
    for r in df.mapInArrow(packed, "b binary").toLocalIterator(prefetchPartitions=True):
        yield pa.ipc.read_record_batch(pa.py_buffer(bytes(r.b)), schema)


def collect_async(df: DataFrame) -> Future:
    """The table, to the driver, on a thread of its own."""
    pool = ThreadPoolExecutor(1)
    out = pool.submit(df.toArrow)
    pool.shutdown(wait=False)
    return out


def profile(df: DataFrame) -> tuple[pa.Table, dict[str, float]]:
    """The table, to the driver, and the milliseconds of each phase: analysis, optimization, planning and execution."""
    begun = time.time()
    table = df.toArrow()
    whole = (time.time() - begun) * 1000
    phases, out = df._jdf.queryExecution().tracker().phases(), {}
    for name in ("parsing", "analysis", "optimization", "planning"):
        if phases.contains(name):
            out[name] = float(phases.apply(name).durationMs())
    return table, out | {"execution": whole}
