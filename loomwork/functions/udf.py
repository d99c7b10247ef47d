"""User functions and the few kernels that need Arrow: bit casts and FNV-1a hashes."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BITS = {("bigint", "double"): (np.int64, np.float64), ("double", "bigint"): (np.float64, np.int64), ("int", "float"): (np.int32, np.float32), ("float", "int"): (np.float32, np.int32)}


def map_elements(c: Column, f: Callable, kind: str) -> Column:
    """f of each value; nulls are passed over."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore").astype(object).where(s.notna(), None)

    return run(c)


def map_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    return df.mapInPandas(lambda it: (f(x) for x in it), schema)


def map_groups(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    return df.groupBy(*keys).applyInPandas(f, schema)


def reinterpret(c: Column, source: str, target: str) -> Column:
    a, b = _BITS[source, target]

    @F.pandas_udf(target)
    def run(s: pd.Series) -> pd.Series:
        out = pd.Series(s.fillna(0).to_numpy(a).view(b))
        return out.astype(object).where(s.notna(), None)

    return run(c)


_BASIS, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(c: Column) -> Column:
    """64-bit FNV-1a of a string's or binary's bytes as decimal(20,0); null hashes to the offset basis. All rows of a batch advance by a byte at a time, longest first."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        held = [b or b"" for b in s]
        size = np.array([len(b) for b in held], np.int64)
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(held), np.uint8)
        begin, size = (np.cumsum(size) - size)[order], size[order]
        h = np.full(len(held), _BASIS, np.uint64)
        n = len(held) - np.searchsorted(size[::-1], np.arange(1, int(size.max(initial=0)) + 1))
        for k, live in enumerate(n.tolist()):
            h[:live] = (h[:live] ^ data[begin[:live] + k]) * np.uint64(_PRIME)
        out = np.empty(len(held), np.uint64)
        out[order] = h
        return pd.Series(out.view(np.int64))

    h = run(c.cast("binary")).cast("decimal(20,0)")
    return F.when(h < 0, h + F.lit(Decimal(1 << 64))).otherwise(h).cast("decimal(20,0)")


def register_aggregate(spark: SparkSession, name: str, f: Callable[[pd.Series], object], kind: str):
    """f of a group's values as an aggregate in SQL and, as returned, on columns. A group comes to one task whole: for bounded groups."""

    @F.pandas_udf(kind)
    def own(s: pd.Series) -> Any:
        return f(s)

    spark.udf.register(name, own)
    return own


def register_table_function(spark: SparkSession, name: str, handler: type, schema: str) -> None:
    """A class with eval(*args) that yields rows, as a table function in SQL (LATERAL joins give it columns)."""
    spark.udtf.register(name, F.udtf(handler, returnType=schema))
