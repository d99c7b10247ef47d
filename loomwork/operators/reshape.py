"""Pivot, unpivot, transpose, explode, unnest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot(df: DataFrame, index: list[str], on: str, values: str, agg: str = "sum", names: list | None = None) -> DataFrame:
    """sum, count (missing cells 0), mean, min, max or first. Give the names to save the pass that finds them."""
    f = {"sum": F.sum, "count": F.count, "mean": F.avg, "min": F.min, "max": F.max, "first": F.first}[agg]
    out = df.groupBy(*index).pivot(on, names).agg(f(values))
    return out.fillna(0, [c for c in out.columns if c not in index]) if agg in ("sum", "count") else out


def unpivot(df: DataFrame, index: list[str], on: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(index, on, variable, value)


def transpose(df: DataFrame, key: str, columns: list[str], include_header: bool = True, header: str = "column", column_names: list[str] | None = None) -> DataFrame:
    """A row for each column, a column for each key value by order of key (column_0, column_1 or the names given, one for each row). The number of rows must be small: they become columns."""
    from pyspark.sql import Window

    limit = int(df.sparkSession.conf.get("spark.sql.transposeMaxValues", "500"))
    rows = df.select(key, *columns).limit(limit + 1)
    if rows.count() > limit:
        raise ValueError(f"more than {limit} rows to turn into columns")
    kinds = {t for c, t in df.select(*columns).dtypes}
    kind = kinds.pop() if len(kinds) == 1 else "double" if kinds <= {"int", "bigint", "double", "float", "smallint", "tinyint"} else "string"
    own = rows.select((F.row_number().over(Window.orderBy(key)) - 1).alias("__i"), *(F.col(c).cast(kind).alias(c) for c in columns))
    n = own.count()
    if column_names is not None and len(column_names) != n:
        raise ValueError(f"{len(column_names)} names for {n} rows")
    names = column_names or [f"column_{i}" for i in range(n)]
    long = own.unpivot(["__i"], columns, header, "__v")
    out = long.groupBy(header).pivot("__i", list(range(n))).agg(F.first("__v")).withColumnsRenamed({str(i): x for i, x in enumerate(names)})
    return out if include_header else out.drop(header)


def explode(df: DataFrame, column: str, keep_empty: bool = True) -> DataFrame:
    f = F.explode_outer if keep_empty else F.explode
    return df.select(*(f(c).alias(c) if c == column else c for c in df.columns))


def unnest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Struct fields in the struct's place."""
    return df.select(*(x for c in df.columns for x in ([f"{c}.*"] if c in columns else [c])))
