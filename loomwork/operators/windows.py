"""Windowed and positional expressions. `o` orders, `p` partitions: Columns come out, so several share one sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frame import order


def spec(o: list[str], p: list[str] = (), descending: bool = False):
    return Window.partitionBy(*p).orderBy(*order(list(o), descending))


def over(aggregate: Column, p: list[str]) -> Column:
    return aggregate.over(Window.partitionBy(*p))


def n_unique_over(df: DataFrame, c: str, p: list[str], name: str) -> DataFrame:
    """Distinct values of each row's partition in a column of its own: an aggregate that is combined before the shuffle, joined back, and no set per row."""
    counts = df.groupBy(*(F.col(x).alias(f"__p{i}") for i, x in enumerate(p))).agg(F.count_distinct(c).alias(name))
    same = reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(f"__p{i}")) for i, x in enumerate(p)))
    return df.drop(name).join(counts, same).drop(*(f"__p{i}" for i in range(len(p))))


def rolling(f, c: str, width: int, o: list[str], p: list[str] = ()) -> Column:
    """f over the last `width` rows; null until so many values are there."""
    w = spec(o, p).rowsBetween(1 - width, 0)
    return F.when(F.count(c).over(w) >= width, f(c).over(w))


def rolling_mean(c, width, o, p=()):
    return rolling(F.avg, c, width, o, p)


def rolling_sum(c, width, o, p=()):
    return rolling(F.sum, c, width, o, p)


def rolling_min(c, width, o, p=()):
    return rolling(F.min, c, width, o, p)


def rolling_max(c, width, o, p=()):
    return rolling(F.max, c, width, o, p)


def rolling_std(c, width, o, p=()):
    return rolling(F.stddev_samp, c, width, o, p)


def expanding(f, c: str, o: list[str], p: list[str] = (), reverse: bool = False) -> Column:
    """f over all rows so far; null where the value is."""
    w = spec(o, p)
    w = w.rowsBetween(0, Window.unboundedFollowing) if reverse else w.rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.col(c).isNotNull(), f(c).over(w))


def cum_sum(c, o, p=(), reverse=False):
    return expanding(F.sum, c, o, p, reverse)


def cum_mean(c, o, p=(), reverse=False):
    return expanding(F.avg, c, o, p, reverse)


def cum_min(c, o, p=(), reverse=False):
    return expanding(F.min, c, o, p, reverse)


def cum_max(c, o, p=(), reverse=False):
    return expanding(F.max, c, o, p, reverse)


def cum_std(c, o, p=(), reverse=False):
    return expanding(F.stddev_samp, c, o, p, reverse)


def cum_prod(c, o, p=(), reverse=False):
    return expanding(F.product, c, o, p, reverse)


def cum_count(c: str, o, p=(), reverse: bool = False) -> Column:
    w = spec(o, p)
    return F.count(c).over(w.rowsBetween(0, Window.unboundedFollowing) if reverse else w.rowsBetween(Window.unboundedPreceding, 0))


def shift(c: str, n: int, o, p=()) -> Column:
    return F.lag(c, n).over(spec(o, p)) if n >= 0 else F.lead(c, -n).over(spec(o, p))


def diff(c: str, n: int, o, p=()) -> Column:
    return (F.col(c) - shift(c, n, o, p)).cast("double")


def pct_change(c: str, n: int, o, p=()) -> Column:
    before = shift(c, n, o, p)
    return F.try_divide(F.col(c) - before, before)


def rank(c: str, p: list[str] = (), descending: bool = False) -> Column:
    """Average rank; null for null."""
    own = F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last()
    return F.when(F.col(c).isNotNull(), F.rank().over(Window.partitionBy(*p).orderBy(own)) + (F.count(F.lit(1)).over(Window.partitionBy(*p, c)) - 1) / 2)


def is_duplicated(*cs: str) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*cs)) > 1


def is_unique(*cs: str) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*cs)) == 1


def is_first(c: str, o: list[str]) -> Column:
    return F.row_number().over(spec(o, [c])) == 1


def fill_forward(c: str, o, p=()) -> Column:
    return F.last(c, True).over(spec(o, p).rowsBetween(Window.unboundedPreceding, 0))


def fill_backward(c: str, o, p=()) -> Column:
    return F.first(c, True).over(spec(o, p).rowsBetween(0, Window.unboundedFollowing))


def fill_with(f, c: str, p=()) -> Column:
    """f (min, max, avg) of the column in place of nulls."""
    return F.coalesce(F.col(c), f(c).over(Window.partitionBy(*p)))


def ewm(df: DataFrame, c: str, alpha: float, o: list[str], p: list[str], mean: str | None = "ewm_mean", std: str | None = None) -> DataFrame:
    """Exponentially weighted mean and bias-corrected deviation per partition, linear in its rows.

    Rows come sorted and stream through Arrow batches; only the recursion's state passes from batch to batch, so a long partition
    needs no more memory than a short one. Without `p` the recursion is one sequence and so one task.
    """
    import pyarrow as pa

    names = [x for x in (mean, std) if x]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{x}` double" for x in names)])
    columns, q = df.columns, 1 - alpha

    def run(batches):
        key, y, var, w2, seen = object(), None, 0.0, 1.0, 0
        for b in batches:
            keys = list(zip(*(b.column(columns.index(k)).to_pylist() for k in p))) if p else [()] * b.num_rows
            means, stds = [], []
            for k, x in zip(keys, b.column(columns.index(c)).to_pylist()):
                if k != key:
                    key, y, var, w2, seen = k, None, 0.0, 1.0, 0
                if x is not None:
                    x = float(x)
                    if seen == 0:
                        y = x
                    else:
                        d = x - y
                        y, var, w2 = y + alpha * d, q * (var + alpha * d * d), q * q * w2 + alpha * alpha
                    seen += 1
                means.append(y)
                stds.append(None if seen == 0 else 0.0 if seen == 1 else (max(0.0, var) / (1 - w2)) ** 0.5)
            extra = [pa.array(v, pa.float64()) for v, n in ((means, mean), (stds, std)) if n]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*columns, *names])

    dealt = df.repartition(*p) if p else df.coalesce(1)
    return dealt.sortWithinPartitions(*p, *order(o)).mapInArrow(run, schema)
