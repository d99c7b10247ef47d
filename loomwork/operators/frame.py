"""Operators on whole frames. Where rows have positions the caller names the order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def free(name: str, *frames: DataFrame) -> str:
    """A name like this one that no column has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def order(cols: list[str], descending: bool = False) -> list[Column]:
    """Nulls first ascending, last descending."""
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in cols]


def sort(df: DataFrame, by: list[str], descending: bool | list[bool] = False) -> DataFrame:
    flags = [descending] * len(by) if isinstance(descending, bool) else descending
    return df.orderBy(*(order([c], d)[0] for c, d in zip(by, flags, strict=True)))


def with_columns(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def limit(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    return df.orderBy(*order(order_by)).limit(n)


def slice_(df: DataFrame, offset: int, length: int, order_by: list[str]) -> DataFrame:
    """Rows offset to offset + length; a negative offset counts from the end. Both are top-k plans, not full sorts with an index."""
    if offset >= 0:
        return df.orderBy(*order(order_by)).offset(offset).limit(length)
    last = df.orderBy(*order(order_by, True)).limit(-offset)
    return last.orderBy(*order(order_by)).limit(length)


def tail(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    return df.orderBy(*order(order_by, True)).limit(n).orderBy(*order(order_by))


def sample(df: DataFrame, n: int, key: list[str], seed: int = 42, with_replacement: bool = False) -> DataFrame:
    """Exactly n rows (all, if fewer), the same on each run: the smallest hashes of a key. With replacement n draws of a uniform position each."""
    if not with_replacement:
        return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)
    from .ranges import row_index

    at = free("__at", df)
    total = df.agg(F.count(F.lit(1)).alias("total")).where("total > 0")
    # Both sides of this join are one row and n.
    draws = df.sparkSession.range(n).crossJoin(total).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.col("total")).alias(at))
    return draws.join(row_index(df, key, at), at).drop(at)


def drop_nulls(df: DataFrame, subset: list[str] | None = None, any_null: bool = True) -> DataFrame:
    """NaN is no null."""
    tests = [F.col(c).isNotNull() for c in subset or df.columns]
    return df.where(reduce(lambda a, b: a & b if any_null else a | b, tests))


def fill_nan(df: DataFrame, value: float) -> DataFrame:
    return df.withColumns({c: F.when(F.isnan(c), F.lit(value)).otherwise(F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def null_count(df: DataFrame) -> DataFrame:
    """column, null_count: one pass."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return counts.unpivot([], counts.columns, "column", "null_count")


def unique(df: DataFrame, subset: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Distinct rows; of those alike in a subset the first by order."""
    if subset is None:
        return df.distinct()
    if order_by is None:
        return df.dropDuplicates(subset)
    first = F.row_number().over(Window.partitionBy(*subset).orderBy(*order(order_by)))
    at = free("__rank", df)
    return df.withColumn(at, first).where(F.col(at) == 1).drop(at)


def shift_columns(df: DataFrame, n: int, columns: list[str], order_by: list[str], partition_by: list[str] = ()) -> DataFrame:
    """Columns moved n rows on within partitions, or, without those, over the whole order in parallel ranges."""
    if not partition_by:
        from .ranges import shift_columns as shifted

        return shifted(df, n, columns, order_by)
    w = Window.partitionBy(*partition_by).orderBy(*order(order_by))
    return df.withColumns({c: F.lag(c, n).over(w) if n >= 0 else F.lead(c, -n).over(w) for c in columns})


def clear(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def describe(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """statistic and a column each: count, null_count, mean, std, min, 25%, 50%, 75%, max, in one pass.

    Exact quartiles keep a column's distinct values; with an accuracy they are sketched in bounded memory (rank error 1 / accuracy).
    `ranges.quantiles` gives exact ones without that buffer.
    """
    cut = (lambda c, q: F.percentile_approx(c, q, accuracy).cast("double")) if accuracy else F.percentile
    stats = {
        "count": lambda c: F.count(c).cast("double"),
        "null_count": lambda c: F.count_if(F.col(c).isNull()).cast("double"),
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": lambda c: F.min(c).cast("double"),
        "25%": lambda c: cut(c, 0.25),
        "50%": lambda c: cut(c, 0.5),
        "75%": lambda c: cut(c, 0.75),
        "max": lambda c: F.max(c).cast("double"),
    }
    one = df.agg(*(F.array(*(F.struct(F.lit(k).alias("s"), f(c).alias("v")) for k, f in stats.items())).alias(c) for c in columns))
    zipped = one.select(F.posexplode(F.arrays_zip(*columns)).alias("i", "z"))
    return zipped.select(F.col(f"z.{columns[0]}.s").alias("statistic"), *(F.col(f"z.{c}.v").alias(c) for c in columns))


def estimated_size(df: DataFrame) -> DataFrame:
    """Bytes: fixed widths of fixed types, lengths of texts and binaries, 8 per list element."""
    width = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8}

    def part(name, kind):
        if kind in width:
            return F.count(F.lit(1)) * width[kind]
        if kind in ("string", "binary"):
            return F.coalesce(F.sum(F.octet_length(name)), F.lit(0)) + F.count(F.lit(1)) * 4
        if kind.startswith("array"):
            return F.coalesce(F.sum(F.size(name)), F.lit(0)) * 8
        return F.count(F.lit(1)) * 16

    return df.agg(reduce(lambda a, b: a + b, (part(*x) for x in df.dtypes)).cast("long").alias("bytes"))


def concat(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _there(df: DataFrame, column: str) -> Column:
    """Neither null nor NaN."""
    return F.col(column).isNotNull() & ~F.isnan(column) if dict(df.dtypes)[column] in ("double", "float") else F.col(column).isNotNull()


def top_k(df: DataFrame, column: str, k: int, ties: list[str] = ()) -> DataFrame:
    """The k largest; nulls and NaN take no part."""
    return df.where(_there(df, column)).orderBy(F.col(column).desc(), *ties).limit(k)


def bottom_k(df: DataFrame, column: str, k: int, ties: list[str] = ()) -> DataFrame:
    """The k smallest; nulls and NaN take no part."""
    return df.where(_there(df, column)).orderBy(F.col(column).asc(), *ties).limit(k)


def search_sorted(df: DataFrame, column: str, value) -> DataFrame:
    """Insertion index: how many values are below."""
    return df.agg(F.count_if(F.col(column) < F.lit(value)).alias("index"))
