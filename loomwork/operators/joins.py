"""Joins. Right columns that clash get the suffix _right (_right2 and so on where that is taken too); sides are broadcast by the planner's sizes, never by force."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frame import free

SUFFIX = "_right"


def _names(left: DataFrame, columns: list[str], keep: list[str] = ()) -> dict[str, str]:
    """Right columns by the name they get: their own, or the first suffixed one that is free."""
    taken, out = {c.lower() for c in left.columns} | {c.lower() for c in columns}, {}
    for c in columns:
        name, k = c, 1
        if c not in keep and c.lower() in {x.lower() for x in left.columns}:
            while (name := c + SUFFIX + (str(k) if k > 1 else "")).lower() in taken:
                k += 1
            taken.add(name.lower())
        out[c] = name
    return out


def _suffixed(left: DataFrame, right: DataFrame, keys: list[str], keep_keys: bool) -> tuple[DataFrame, dict[str, str]]:
    names = _names(left, right.columns, () if keep_keys else keys)
    return right.withColumnsRenamed({a: b for a, b in names.items() if a != b}), names


def join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """inner, left, outer (keeps both keys), semi, anti or cross."""
    keys = [on] if isinstance(on, str) else list(on)
    if how == "cross":
        return left.crossJoin(_suffixed(left, right, [], False)[0])
    if how in ("semi", "anti"):
        return left.join(right, keys, f"left_{how}")
    if how == "outer":
        r, names = _suffixed(left, right, keys, True)
        return left.join(r, reduce(lambda a, b: a & b, (left[k] == r[names[k]] for k in keys)), "full")
    return left.join(_suffixed(left, right, keys, False)[0], keys, how)


def join_on(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], how: str = "inner") -> DataFrame:
    r, names = _suffixed(left, right, [], False)
    return left.join(r, reduce(lambda a, b: a & b, (left[a] == r[names[b]] for a, b in zip(left_on, right_on, strict=True))), how)


def theta(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    return left.join(right, condition, how)


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str] = (), strategy: str = "backward", tolerance: int | None = None, right_order_by: list[str] = (), spread: bool | None = None) -> DataFrame:
    """Each left row with the right row whose key is the nearest at or before (backward), at or after (forward), or either (nearest; ties backward).

    Null keys, and null values of `by`, match nothing; their left rows stay, with nulls. Of right rows with equal keys the last by `right_order_by` is
    taken, going forward the first. Both sides are put in one order and the last right row is carried on, so nothing is paired: one shuffle by `by`. With `spread`
    (always, without `by`) a value of `by` is dealt over ranges of the key too, and what comes before and after each range is
    carried to it: for keys that a large share of the rows have.
    """
    from .ranges import ranged

    by = list(by)
    side, key, mine, other, rank, part = (free(x, left, right) for x in ("__side", "__key", "__left", "__right", "__tie", "__range"))
    out = _names(left, [c for c in right.columns if c not in (on, *by)])
    r = right.where(F.col(on).isNotNull()).select(F.col(on).alias(key), *by, F.lit(0).alias(side), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias(mine), F.struct(F.col(on).alias(key), *out).alias(other), F.struct(F.lit(0).alias("z"), *right_order_by).alias(rank))
    rows = left.select(F.col(on).alias(key), *by, F.lit(1).alias(side), F.struct("*").alias(mine), F.lit(None).cast(r.schema[other].dataType).alias(other), F.lit(None).cast(r.schema[rank].dataType).alias(rank))
    both = r.unionByName(rows)
    spread = not by if spread is None else spread
    if spread:
        both = ranged(both, [key], part)
    window = Window.partitionBy(*by, *([part] if spread else []))
    back = window.orderBy(key, side, rank).rowsBetween(Window.unboundedPreceding, 0)
    ahead = window.orderBy(F.col(key).desc_nulls_last(), side, F.col(rank).desc()).rowsBetween(Window.unboundedPreceding, 0)
    before, after = F.last(other, True).over(back), F.last(other, True).over(ahead)
    found = both.withColumns({"__before": before if strategy != "forward" else F.lit(None).cast(r.schema[other].dataType), "__after": after if strategy != "backward" else F.lit(None).cast(r.schema[other].dataType)}).where(F.col(side) == 1)
    if spread:
        ends = F.struct(key, rank)
        seen = F.col(side) == 0
        total = both.groupBy(*by, part).agg(F.max_by(other, F.when(seen, ends)).alias("__last"), F.min_by(other, F.when(seen, ends)).alias("__top"))
        along = Window.partitionBy(*by).orderBy(part)
        carried = total.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.col(part).alias("__at"), F.last("__last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"), F.first("__top", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("__next"))
        match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)), F.col(part) == F.col("__at"))
        found = found.join(carried, match, "left").withColumns({"__before": F.coalesce("__before", "__carry") if strategy != "forward" else F.col("__before"), "__after": F.coalesce("__after", "__next") if strategy != "backward" else F.col("__after")})
    kinds = dict(right.dtypes)
    number = lambda c: F.unix_micros(c.cast("timestamp")) if kinds[on].startswith("timestamp") else c
    gap = lambda c: F.abs(number(F.col(key)) - number(F.col(f"{c}.{key}")))
    if strategy == "nearest":
        pick = F.when(F.col("__after").isNull() | (gap("__before") <= gap("__after")), F.col("__before")).otherwise(F.col("__after"))
    else:
        pick = F.col("__before" if strategy == "backward" else "__after")
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in by), F.col(key).isNotNull())
    found = found.withColumn("__pick", F.when(known, pick))
    if tolerance is not None:
        found = found.withColumn("__pick", F.when(gap("__pick") <= tolerance, F.col("__pick")))
    return found.select(f"{mine}.*", *(F.col(f"__pick.{a}").alias(b) for a, b in out.items()))
