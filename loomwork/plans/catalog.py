"""Queries over the star-schema tables, one or more per operator, each with the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import binary, categories, lists, maps, scalar, strings, temporal, udf
from ..operators import frame, grouping, joins, ranges, reshape, stats, windows
from ..session import work_path
from ..sources import files
from ..streaming import windows as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: The total order of lineitem.
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LO = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


#: Added on both sides before rounding where exact ties occur, as float sums fall on either side of those.
TIE = 1e-7


class Tables:
    """Tables by attribute, read when named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def live(self, name: str) -> DataFrame:
        """A table as a stream of its files; as a pattern the path may name a file or a folder."""
        return self.spark.readStream.schema(getattr(self, name).schema).parquet(f"{self.dir}/{{{name}}}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r(c, n=4):
    """Rounded double, without a negative zero."""
    return F.round(c.cast("double") if not isinstance(c, str) else F.col(c).cast("double"), n) + F.lit(0.0)


def big(c):
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def gapped(t: Tables) -> DataFrame:
    """Events with every fifth value missing."""
    return t.events.withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")))


GAP = "(SELECT *, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events)"


# --- 2.3 projection, filter, rows


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def q01_agg_pricing(t):
    own = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus")
    return own.agg(r(F.sum("l_quantity"), 2).alias("sum_qty"), r(F.sum("l_extendedprice"), 2).alias("sum_base_price"), r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), r(F.avg("l_quantity")).alias("avg_qty"), r(F.avg("l_discount")).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"))


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.05")
def filter_project(t):
    return t.lineitem.where("l_quantity > 45 AND l_discount >= 0.05").select("l_orderkey", "l_extendedprice")


@query("SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, o_totalprice + 1 AS plus_one FROM orders")
def with_columns_overwrite(t):
    return frame.with_columns(t.orders.select("o_orderkey", "o_totalprice"), o_totalprice=F.col("o_totalprice") * 2, plus_one=F.col("o_totalprice") + 1)


@query("SELECT r_regionkey AS key, r_name AS name, 7 AS seven, 'x' AS text FROM region")
def select_alias_lit(t):
    return frame.rename(t.region, {"r_regionkey": "key", "r_name": "name"}).select("key", "name", F.lit(7).alias("seven"), F.lit("x").alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END AS band FROM orders")
def when_then(t):
    return t.orders.select("o_orderkey", scalar.when_then(F.col("o_totalprice") > 200000, F.lit("high"), F.lit("low")).alias("band"))


@query("SELECT p_partkey, try_cast(split_part(p_brand, '#', 2) AS BIGINT) AS brand_no, try_cast(p_name AS DOUBLE) AS name_no, CAST(p_size AS DOUBLE) AS size_f FROM part")
def cast_try(t):
    return t.part.select("p_partkey", scalar.cast(F.split_part("p_brand", F.lit("#"), F.lit(2)), "bigint").alias("brand_no"), scalar.cast(F.col("p_name"), "double").alias("name_no"), scalar.cast(F.col("p_size"), "double").alias("size_f"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_limit(t):
    return frame.sort(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], [True, False]).limit(25)


@query("SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def sort_multi(t):
    return frame.sort(t.customer, ["c_mktsegment", "c_acctbal", "c_custkey"], [False, True, False]).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 17")
def limit(t):
    return frame.limit(t.customer.select("c_custkey", "c_name"), 17, ["c_custkey"])


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 5")
def slice_offset(t):
    return frame.slice_(t.customer.select("c_custkey"), 5, 10, ["c_custkey"])


@query("SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 8) ORDER BY 1 LIMIT 3")
def slice_negative(t):
    return frame.slice_(t.customer.select("c_custkey"), -8, 3, ["c_custkey"])


@query("SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 12")
def tail(t):
    return frame.tail(t.customer.select("c_custkey"), 12, ["c_custkey"])


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS index, o_orderkey FROM orders")
def with_row_index(t):
    return ranges.row_index(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select(big("index").alias("index"), "o_orderkey")


@query(f"SELECT event_id FROM {GAP} WHERE v IS NOT NULL")
def drop_nulls(t):
    return frame.drop_nulls(gapped(t), ["v", "user_id"]).select("event_id")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value END AS x FROM events")
def fill_nan(t):
    return frame.fill_nan(t.events.select("event_id", F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")).alias("x")), 0.0)


@query(f"SELECT 'event_id' AS \"column\", count(*) - count(event_id) AS null_count FROM {GAP} UNION ALL SELECT 'v', count(*) - count(v) FROM {GAP}")
def null_count(t):
    return frame.null_count(gapped(t).select("event_id", "v"))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def unique_rows(t):
    return frame.unique(t.customer.select("c_mktsegment", "c_nationkey"))


@query("SELECT c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY 1")
def unique_subset_first(t):
    return frame.unique(t.customer.select("c_mktsegment", "c_custkey"), ["c_mktsegment"], ["c_custkey"])


@query("SELECT event_id, lag(event_type, 2) OVER w AS event_type, lag(user_id, 2) OVER w AS user_id FROM events WINDOW w AS (ORDER BY event_id)")
def shift_columns(t):
    return frame.shift_columns(t.events.select("event_id", "event_type", "user_id"), 2, ["event_type", "user_id"], ["event_id"])


@query("SELECT o_orderkey FROM orders WHERE false")
def clear(t):
    return frame.clear(t.orders.select("o_orderkey"))


@query("SELECT statistic, round(p, 4) AS o_totalprice FROM (SELECT unnest(['count','null_count','mean','std','min','25%','50%','75%','max']) AS statistic, unnest([count(o_totalprice)::DOUBLE, 0.0::DOUBLE, avg(o_totalprice), stddev_samp(o_totalprice), min(o_totalprice), quantile_cont(o_totalprice, 0.25), quantile_cont(o_totalprice, 0.5), quantile_cont(o_totalprice, 0.75), max(o_totalprice)]) AS p FROM orders)")
def describe(t):
    return frame.describe(t.orders, ["o_totalprice"]).select("statistic", r("o_totalprice").alias("o_totalprice"))


@query("SELECT CAST(count(*) * 8 + sum(strlen(n_name)) + count(*) * 4 AS BIGINT) AS bytes FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation)")
def estimated_size(t):
    return frame.estimated_size(t.nation.select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def concat_rows(t):
    return frame.concat(t.nation.select(F.col("n_name").alias("name")), t.region.select(F.col("r_name").alias("name")))


@query("SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t):
    return t.customer.select("c_nationkey").intersect(t.supplier.select("s_nationkey"))


NULLED = "SELECT CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS k FROM customer"


@query(f"SELECT k FROM ({NULLED}) EXCEPT SELECT CASE WHEN o_totalprice > 250000 THEN o_custkey END FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000")
def set_except(t):
    own = t.customer.select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("k"))
    return own.subtract(t.orders.where("o_orderstatus = 'F' AND o_totalprice > 250000").select("o_custkey"))


@query(f"SELECT k FROM ({NULLED}) EXCEPT ALL SELECT n_nationkey FROM nation")
def set_except_all(t):
    return t.customer.select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("k")).exceptAll(t.nation.select("n_nationkey"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def top_k(t):
    return frame.top_k(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", 10, ["p_partkey"])


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 10")
def bottom_k(t):
    return frame.bottom_k(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", 10, ["p_partkey"])


def _sampled(t, **how):
    """What a sample of 100 rows has to be: rows, distinct ones, those of the table, and whether another run draws the same."""
    own = t.orders.select("o_orderkey")
    one, two = (frame.sample(own, 100, ["o_orderkey"], **how) for _ in range(2))
    known = own.withColumn("known", F.lit(1))
    seen = one.join(known, "o_orderkey", "left").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("distinct_n"), F.sum("known").alias("known"))
    return seen.crossJoin(one.exceptAll(two).agg(F.count(F.lit(1)).alias("other")))


@query("SELECT least(100, count(*)) AS n, least(100, count(*)) AS distinct_n, CAST(least(100, count(*)) AS BIGINT) AS known, 0 AS other FROM orders")
def sample_exact(t):
    return _sampled(t)


@query("SELECT 100 AS n, CAST(100 AS BIGINT) AS known, 0 AS other")
def sample_with_replacement(t):
    return _sampled(t, with_replacement=True).drop("distinct_n")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i >= 2 AND (i - 2) % 7 = 0")
def gather_every(t):
    return ranges.gather_every(t.events.select("event_id"), 7, 2, ["event_id"])


@query("SELECT count(*) FILTER (WHERE o_totalprice < 100000) AS index FROM orders")
def search_sorted(t):
    return frame.search_sorted(t.orders, "o_totalprice", 100000)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def is_in(t):
    return t.orders.where(scalar.is_in(F.col("o_orderstatus"), ["F", "P"])).select("o_orderkey")


# --- 2.4 arithmetic, logic, missing values


@query("SELECT l_orderkey, l_linenumber + 1 AS plus, l_linenumber - 2 AS minus, l_linenumber * 3 AS times, l_linenumber / 2 AS over, l_linenumber // 2 AS whole, -l_linenumber AS neg FROM lineitem")
def arithmetic(t):
    n = F.col("l_linenumber")
    return t.lineitem.select("l_orderkey", (n + 1).alias("plus"), (n - 2).alias("minus"), (n * 3).alias("times"), scalar.true_div(n, F.lit(2)).alias("over"), scalar.floor_div(n, F.lit(2)).cast("int").alias("whole"), (-n).alias("neg"))


@query("SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(12, 2)) * 3 + CAST(0.25 AS DECIMAL(3, 2)) AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS none FROM customer")
def decimal_arithmetic(t):
    x = scalar.cast(F.col("c_acctbal"), "decimal(12,2)")
    return t.customer.select("c_custkey", (x * 3 + F.lit("0.25").cast("decimal(3,2)")).cast("double").alias("x"), (x + F.lit(None).cast("decimal(12,2)")).cast("double").alias("none"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN value > 0 THEN 'inf' WHEN value < 0 THEN '-inf' ELSE 'nan' END ELSE 'finite' END AS kind FROM events")
def division_by_zero(t):
    x = scalar.true_div(F.col("value"), F.col("event_id") % 4)
    return t.events.select("event_id", F.when(F.isnan(x), "nan").when(x == scalar.INF, "inf").when(x == -scalar.INF, "-inf").otherwise("finite").alias("kind"))


@query(f"SELECT event_id, v > 50 AND user_id > 10 AS a, v > 50 OR user_id > 10 AS o, NOT (v > 50) AS n FROM {GAP}")
def three_valued_logic(t):
    a, b = F.col("v") > 50, F.col("user_id") > 10
    return gapped(t).select("event_id", (a & b).alias("a"), (a | b).alias("o"), (~a).alias("n"))


@query("SELECT o_orderkey, o_totalprice = 1000 AS eq, o_totalprice <> 1000 AS ne, o_totalprice > 1000 AS gt, o_totalprice <= 1000 AS le, o_orderstatus < 'O' AS lt FROM orders")
def comparisons(t):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", (p == 1000).alias("eq"), (p != 1000).alias("ne"), (p > 1000).alias("gt"), (p <= 1000).alias("le"), (F.col("o_orderstatus") < "O").alias("lt"))


@query(f"SELECT event_id, v IS NULL AS missing, v IS NOT NULL AS present FROM {GAP}")
def is_null(t):
    return gapped(t).select("event_id", F.col("v").isNull().alias("missing"), F.col("v").isNotNull().alias("present"))


@query(f"SELECT event_id, coalesce(v, 99) AS lit, coalesce(v, user_id) AS other, coalesce(v, 0) AS zero, coalesce(v, 1) AS one FROM {GAP}")
def fill_null_literal(t):
    v = F.col("v")
    return gapped(t).select("event_id", scalar.fill_null(v, 99.0).alias("lit"), scalar.fill_null(v, F.col("user_id").cast("double")).alias("other"), scalar.fill_null(v, 0.0).alias("zero"), scalar.fill_null(v, 1.0).alias("one"))


@query(f"SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM {GAP}")
def fill_null_forward(t):
    return gapped(t).select("event_id", windows.fill_forward("v", ["event_id"], ["user_id"]).alias("f"))


@query(f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM {GAP}")
def fill_null_forward_global(t):
    return ranges.fill_forward(gapped(t).select("event_id", "v"), "v", ["event_id"], "f").select("event_id", "f")


@query(f"SELECT event_id, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM {GAP}")
def fill_null_backward(t):
    return gapped(t).select("event_id", windows.fill_backward("v", ["event_id"], ["user_id"]).alias("b"))


@query(f"SELECT event_id, round(coalesce(v, min(v) OVER w), 4) AS lo, round(coalesce(v, max(v) OVER w), 4) AS hi, round(coalesce(v, avg(v) OVER w), 4) AS mid FROM {GAP} WINDOW w AS (PARTITION BY event_type)")
def fill_null_stats(t):
    p = ["event_type"]
    return gapped(t).select("event_id", r(windows.fill_with(F.min, "v", p)).alias("lo"), r(windows.fill_with(F.max, "v", p)).alias("hi"), r(windows.fill_with(F.avg, "v", p)).alias("mid"))


# --- 2.5 joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t):
    return joins.join_on(t.orders, t.customer, ["o_custkey"], ["c_custkey"]).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
def join_left(t):
    return joins.join_on(t.customer, t.orders.where("o_totalprice > 300000"), ["c_custkey"], ["o_custkey"], "left").select("c_custkey", "o_orderkey")


@query("SELECT a.k AS k, a.x AS x, b.k AS k_right, b.x AS x_right FROM (SELECT 2 * c_custkey AS k, c_acctbal AS x FROM customer) a FULL JOIN (SELECT 3 * s_suppkey AS k, s_acctbal AS x FROM supplier) b ON a.k = b.k")
def join_outer(t):
    """Both whole tables; the keys are such that each side has rows that match none."""
    a = t.customer.select((2 * F.col("c_custkey")).alias("k"), F.col("c_acctbal").alias("x"))
    return joins.join(a, t.supplier.select((3 * F.col("s_suppkey")).alias("k"), F.col("s_acctbal").alias("x")), "k", "outer")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return joins.join(t.region, t.nation, [], "cross").select("r_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(t):
    return joins.join(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "semi")


@query(f"SELECT k FROM ({NULLED}) c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = k AND o_totalprice > 250000)")
def join_anti(t):
    own = t.customer.select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("k"))
    return joins.join(own, t.orders.where("o_totalprice > 250000").select(F.col("o_custkey").alias("k")), "k", "anti")


@query("SELECT a.n_nationkey AS n_nationkey, a.n_name AS n_name, b.n_name AS n_name_right, c.n_name AS n_name_right2 FROM nation a JOIN nation b USING (n_nationkey) LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) c ON c.n_nationkey = a.n_nationkey")
def join_chained_suffixes(t):
    own, some = t.nation.select("n_nationkey", "n_name"), t.nation.where("n_regionkey = 1").select("n_nationkey", "n_name")
    return joins.join(joins.join(own, own, "n_nationkey"), some, "n_nationkey", "left")


@query("SELECT n_name, s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > n_nationkey * 100")
def join_theta(t):
    return joins.theta(t.nation, t.supplier, (F.col("n_nationkey") == F.col("s_nationkey")) & (F.col("s_acctbal") > F.col("n_nationkey") * 100)).select("n_name", "s_name")


ASOF_L = "(SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')"
ASOF_R = "(SELECT user_id, ts, max(event_id) AS rid FROM events WHERE event_type <> 'purchase' GROUP BY user_id, ts)"


def _asof_sides(t):
    """Purchases, and all other events."""
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return left, t.events.where("event_type <> 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("rid"))


@query(f"SELECT l.event_id, r.rid FROM {ASOF_L} l ASOF LEFT JOIN {ASOF_R} r ON l.user_id = r.user_id AND l.ts >= r.ts")
def join_asof(t):
    return joins.asof(*_asof_sides(t), "ts", ["user_id"]).select("event_id", "rid")


@query(f"SELECT l.event_id, r.rid FROM {ASOF_L} l ASOF LEFT JOIN {ASOF_R} r ON l.user_id = r.user_id AND l.ts <= r.ts")
def join_asof_forward(t):
    return joins.asof(*_asof_sides(t), "ts", ["user_id"], strategy="forward").select("event_id", "rid")


@query(f"SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(rts) <= 3600000000 THEN rid END AS rid FROM (SELECT l.event_id, l.ts, r.ts AS rts, r.rid FROM {ASOF_L} l ASOF LEFT JOIN {ASOF_R} r ON l.user_id = r.user_id AND l.ts >= r.ts)")
def join_asof_tolerance(t):
    return joins.asof(*_asof_sides(t), "ts", ["user_id"], tolerance=3_600_000_000).select("event_id", "rid")


@query(f"SELECT b.event_id, CASE WHEN f.rid IS NULL OR epoch_us(b.ts) - epoch_us(b.rts) <= epoch_us(f.rts) - epoch_us(b.ts) THEN b.rid ELSE f.rid END AS rid FROM (SELECT l.event_id, l.ts, r.ts AS rts, r.rid FROM {ASOF_L} l ASOF LEFT JOIN {ASOF_R} r ON l.user_id = r.user_id AND l.ts >= r.ts) b JOIN (SELECT l.event_id, r.ts AS rts, r.rid FROM {ASOF_L} l ASOF LEFT JOIN {ASOF_R} r ON l.user_id = r.user_id AND l.ts <= r.ts) f ON b.event_id = f.event_id")
def join_asof_nearest(t):
    return joins.asof(*_asof_sides(t), "ts", ["user_id"], strategy="nearest").select("event_id", "rid")


ASOF_ALL = "(SELECT ts, max(event_id) AS rid FROM events WHERE event_type <> 'purchase' GROUP BY ts)"


def _asof_all(t):
    left, right = _asof_sides(t)
    return left, right.groupBy("ts").agg(F.max("rid").alias("rid"))


@query(f"SELECT l.event_id, r.rid FROM {ASOF_L} l ASOF LEFT JOIN {ASOF_ALL} r ON l.ts >= r.ts")
def join_asof_whole_order(t):
    return joins.asof(*_asof_all(t), "ts").select("event_id", "rid")


@query(f"SELECT l.event_id, r.rid FROM {ASOF_L} l ASOF LEFT JOIN {ASOF_ALL} r ON l.ts <= r.ts")
def join_asof_whole_order_forward(t):
    return joins.asof(*_asof_all(t), "ts", strategy="forward").select("event_id", "rid")


ASOF_NULLS = "(SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts FROM events)"


@query(f"SELECT l.event_id, r.rid FROM {ASOF_NULLS} l LEFT JOIN (SELECT a.event_id, r.rid FROM {ASOF_NULLS} a ASOF JOIN (SELECT user_id, ts, max(event_id) AS rid FROM {ASOF_NULLS} WHERE ts IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id, ts) r ON a.user_id = r.user_id AND a.ts >= r.ts WHERE a.ts IS NOT NULL AND a.user_id IS NOT NULL) r ON l.event_id = r.event_id")
def join_asof_null_keys(t):
    own = t.events.select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"))
    right = own.groupBy("user_id", "ts").agg(F.max("event_id").alias("rid"))
    return joins.asof(own, right, "ts", ["user_id"], spread=True).select("event_id", "rid")


@query("SELECT r_name, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' GROUP BY ALL")
def join_star(t):
    own = t.orders.where("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return own.groupBy("r_name", "o_orderpriority").agg(r(F.sum("o_totalprice"), 2).alias("total"))


# --- 2.6 grouping and aggregation


@query("SELECT l_suppkey, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 4) AS l_quantity_mean, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, count(l_quantity) AS l_quantity_count FROM lineitem GROUP BY 1")
def groupby_multi(t):
    out = grouping.agg(t.lineitem, ["l_suppkey"], *(("l_quantity", f) for f in ("sum", "mean", "min", "max", "count")))
    return out.withColumns({"l_quantity_sum": r("l_quantity_sum", 2), "l_quantity_mean": r("l_quantity_mean")})


@query("SELECT l_returnflag, round(stddev_samp(l_extendedprice), 3) AS sd, round(var_samp(l_discount), 6) AS vr, median(l_quantity) AS md, quantile_cont(l_extendedprice, 0.9) AS q90 FROM lineitem GROUP BY 1")
def groupby_stats(t):
    return t.lineitem.groupBy("l_returnflag").agg(r(F.stddev_samp("l_extendedprice"), 3).alias("sd"), r(F.var_samp("l_discount"), 6).alias("vr"), F.median("l_quantity").alias("md"), grouping.quantile("l_extendedprice", 0.9).alias("q90"))


@query(f"SELECT event_type, count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS n, count(*) - count(v) AS nulls, CAST(sum(CASE WHEN v > 50 THEN 1 ELSE 0 END) AS BIGINT) * 2.0::DOUBLE AS twice FROM {GAP} GROUP BY 1")
def groupby_nunique(t):
    return gapped(t).groupBy("event_type").agg(big(grouping.n_unique("v")).alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), (F.count_if(F.col("v") > 50) * F.lit(2.0)).alias("twice"))


@query(f"SELECT user_id, arg_min(v, event_id) FILTER (WHERE v IS NOT NULL) AS f, arg_max(v, event_id) FILTER (WHERE v IS NOT NULL) AS l FROM {GAP} GROUP BY 1")
def groupby_first_last(t):
    return gapped(t).groupBy("user_id").agg(grouping.first("v", ["event_id"]).alias("f"), grouping.last("v", ["event_id"]).alias("l"))


@query("SELECT event_type, arg_min(event_id, struct_pack(a := value, b := event_id)) AS lo, arg_max(event_id, struct_pack(a := value, b := -event_id)) AS hi FROM events GROUP BY 1")
def groupby_arg_minmax(t):
    return t.events.groupBy("event_type").agg(grouping.arg_min("value", "event_id").alias("lo"), grouping.arg_max("value", "event_id").alias("hi"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY 1")
def groupby_implode(t):
    return t.conversations.groupBy("conv_id").agg(lists.join(grouping.implode("role", ["turn"]), ",").alias("roles"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS groups FROM customer GROUP BY 1")
def agg_groups(t):
    out = grouping.agg_groups(t.customer, ["c_mktsegment"], "c_custkey")
    return out.select("c_mktsegment", lists.join(F.col("groups"), ",").alias("groups"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def groupby_rollup(t):
    return t.customer.rollup("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def groupby_cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(o_totalprice) AS n, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS m, round(stddev_samp(o_totalprice), 3) AS sd, median(o_totalprice) AS md, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
def scalar_aggregates(t):
    p = "o_totalprice"
    return t.orders.agg(F.count(p).alias("n"), r(F.sum(p), 2).alias("s"), r(F.avg(p)).alias("m"), r(F.stddev_samp(p), 3).alias("sd"), F.median(p).alias("md"), F.min(p).alias("lo"), F.max(p).alias("hi"))


@query("SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def value_counts(t):
    return stats.value_counts(t.orders, "o_orderpriority")


@query("SELECT round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 8) AS entropy FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)")
def entropy(t):
    return stats.entropy(t.orders, "o_orderpriority").select(r("entropy", 8).alias("entropy"))


@query("WITH b AS (SELECT min(p_retailprice) AS lo, (max(p_retailprice) - min(p_retailprice)) / 10 AS w FROM part), c AS (SELECT least(CAST(floor((p_retailprice - lo) / w) AS INT), 9) AS k, count(*) AS n FROM part, b GROUP BY 1) SELECT round(lo + k * w, 4) AS bin_start, round(lo + (k + 1) * w, 4) AS bin_end, coalesce(n, 0) AS count FROM (SELECT unnest(range(10)) AS k) LEFT JOIN c USING (k), b")
def hist(t):
    return stats.hist(t.part, "p_retailprice", 10).select(r("bin_start").alias("bin_start"), r("bin_end").alias("bin_end"), "count")


FINITE = "(SELECT value FROM events WHERE event_id % 4 <> 0 AND event_id % 9 <> 0)"


@query(f"WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 8 AS w FROM {FINITE}), c AS (SELECT least(CAST(floor((value - lo) / w) AS INT), 7) AS k, count(*) AS n FROM {FINITE}, b GROUP BY 1) SELECT round(lo + k * w, 4) AS bin_start, round(lo + (k + 1) * w, 4) AS bin_end, coalesce(n, 0) AS count FROM (SELECT unnest(range(8)) AS k) LEFT JOIN c USING (k), b")
def hist_without_nan(t):
    x = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).when(F.col("event_id") % 9 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return stats.hist(t.events.select(x.alias("x")), "x", 8).select(r("bin_start").alias("bin_start"), r("bin_end").alias("bin_end"), "count")


@query("SELECT event_id, value FROM events WHERE event_id % 3 <> 0 AND event_id % 4 <> 0 ORDER BY value DESC, event_id LIMIT 20")
def top_k_without_nan(t):
    x = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 != 0, F.col("value"))
    return frame.top_k(t.events.select("event_id", x.alias("value")), "value", 20, ["event_id"])


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'nan' WHEN event_id % 3 = 0 THEN NULL ELSE CAST(round(least(greatest(value, 20), 60), 4) AS VARCHAR) END IS NULL AS missing, event_id % 4 = 0 AS nan, CASE WHEN event_id % 4 <> 0 AND event_id % 3 <> 0 THEN round(least(greatest(value, 20), 60), 4) END AS x FROM events")
def clip_nan(t):
    x = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 != 0, F.col("value"))
    c = scalar.clip(x, 20, 60)
    return t.events.select("event_id", c.isNull().alias("missing"), F.coalesce(F.isnan(c), F.lit(False)).alias("nan"), F.when(~F.isnan(c), r(c)).alias("x"))


@query("WITH b AS (SELECT min(p_size) - 6.0 AS lo, max(p_size) + 6.0 AS hi, count(*) AS n FROM part), g AS (SELECT lo + k * (hi - lo) / 49 AS grid, n FROM (SELECT unnest(range(50)) AS k), b) SELECT round(grid, 4) AS grid, round(sum(exp(-0.5 * pow((grid - p_size) / 2.0, 2))) / (any_value(n) * 2.0 * sqrt(2 * pi())), 8) AS density FROM g, part GROUP BY 1")
def kde(t):
    return stats.kde(t.part, "p_size", 2.0, 50).select(r("grid").alias("grid"), r("density", 8).alias("density"))


@query("SELECT date_trunc('hour', ts) AS ts, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY 1")
def dynamic_tumbling(t):
    return grouping.dynamic(t.events, "ts", "1h", [F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("s")])


@query("SELECT k * 50 AS event_id, count(*) AS n FROM (SELECT unnest(range(-3, 100000)) AS k) JOIN events ON event_id > k * 50 AND event_id <= k * 50 + 120 GROUP BY 1")
def dynamic_overlapping_right(t):
    return grouping.dynamic(t.events, "event_id", 50, [F.count(F.lit(1)).alias("n")], period=120, closed="right").select(big("event_id").alias("event_id"), "n")


@query("SELECT event_type, k * 100 + 30 AS start, count(*) AS n FROM (SELECT unnest(range(-3, 50000)) AS k) JOIN events ON event_id >= k * 100 + 30 AND event_id <= k * 100 + 130 GROUP BY 1, 2")
def dynamic_both_offset_by(t):
    return grouping.dynamic(t.events, "event_id", 100, [F.count(F.lit(1)).alias("n")], offset=30, closed="both", by=["event_type"], label="start").select("event_type", big("start").alias("start"), "n")


@query("WITH b AS (SELECT min(event_id) AS lo FROM events) SELECT lo + k * 60 AS start, count(*) AS n FROM b, (SELECT unnest(range(-3, 50000)) AS k) JOIN events ON event_id >= lo + k * 60 AND event_id < lo + k * 60 + 90 GROUP BY 1")
def dynamic_start_by_datapoint(t):
    return grouping.dynamic(t.events, "event_id", 60, [F.count(F.lit(1)).alias("n")], period=90, label="start", start_by="datapoint").select(big("start").alias("start"), "n")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW) AS n, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW), 2) AS s FROM events")
def rolling_group(t):
    out = grouping.rolling(t.events, "ts", "2h", {"n": F.count(F.lit(1)), "s": F.sum("value")}, by=["user_id"])
    return out.select("event_id", "n", r("s", 2).alias("s"))


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, round(max(c_acctbal) - min(c_acctbal), 2) AS spread FROM customer GROUP BY 1")
def map_groups(t):
    def f(pdf):
        import pandas as pd

        return pd.DataFrame({"c_mktsegment": [pdf.c_mktsegment.iloc[0]], "n": [len(pdf)], "spread": [round(pdf.c_acctbal.max() - pdf.c_acctbal.min(), 2)]})

    return udf.map_groups(t.customer.select("c_mktsegment", "c_acctbal"), ["c_mktsegment"], f, "c_mktsegment string, n long, spread double")


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS n, true AS near FROM orders GROUP BY 1")
def approx_n_unique(t):
    """Whether the sketch is within six times its relative deviation of the exact count."""
    own = t.orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n"), F.approx_count_distinct("o_custkey", 0.02).alias("about"))
    return own.select("o_orderpriority", "n", (F.abs(F.col("about") - F.col("n")) <= 1 + 0.12 * F.col("n")).alias("near"))


# --- 2.7 windows


@query("SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def over_fraction(t):
    return t.orders.select("o_orderkey", r(F.col("o_totalprice") / windows.over(F.sum("o_totalprice"), ["o_custkey"]), 6).alias("share"))


@query("SELECT o_orderkey, CAST(list_unique(list(o_orderpriority) OVER (PARTITION BY o_custkey)) AS BIGINT) AS n FROM orders")
def over_n_unique(t):
    return windows.n_unique_over(t.orders.select("o_orderkey", "o_orderpriority", "o_custkey"), "o_orderpriority", ["o_custkey"], "n").select("o_orderkey", "n")


ROLL = "PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW"


@query(f"SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN round(avg(value) OVER w, 4) END AS mean, CASE WHEN count(value) OVER w >= 5 THEN round(sum(value) OVER w, 4) END AS sum, CASE WHEN count(value) OVER w >= 5 THEN min(value) OVER w END AS lo, CASE WHEN count(value) OVER w >= 5 THEN max(value) OVER w END AS hi, CASE WHEN count(value) OVER w >= 5 THEN round(stddev_samp(value) OVER w, 4) END AS sd FROM events WINDOW w AS ({ROLL})")
def rolling_all(t):
    a = ("value", 5, ["event_id"], ["user_id"])
    return t.events.select("event_id", r(windows.rolling_mean(*a)).alias("mean"), r(windows.rolling_sum(*a)).alias("sum"), windows.rolling_min(*a).alias("lo"), windows.rolling_max(*a).alias("hi"), r(windows.rolling_std(*a)).alias("sd"))


CUM = "PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query(f"SELECT event_id, CASE WHEN v IS NOT NULL THEN round(sum(v) OVER w, 3) END AS s, CASE WHEN v IS NOT NULL THEN round(avg(v) OVER w + 1e-7, 4) END AS m, CASE WHEN v IS NOT NULL THEN min(v) OVER w END AS lo, CASE WHEN v IS NOT NULL THEN max(v) OVER w END AS hi, CASE WHEN v IS NOT NULL THEN round(stddev_samp(v) OVER w, 4) END AS sd, count(v) OVER w AS n FROM {GAP} WINDOW w AS ({CUM})")
def cumulative_all(t):
    a = ("v", ["event_id"], ["user_id"])
    return gapped(t).select("event_id", r(windows.cum_sum(*a), 3).alias("s"), r(windows.cum_mean(*a) + TIE).alias("m"), windows.cum_min(*a).alias("lo"), windows.cum_max(*a).alias("hi"), r(windows.cum_std(*a)).alias("sd"), windows.cum_count(*a).alias("n"))


@query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) AS s, max(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS hi FROM events")
def cumulative_global(t):
    own = ranges.scan(t.events.select("event_id", "value"), ["event_id"], ranges.sum_value("value", "s"), ranges.max_value("value", "hi"))
    return own.select("event_id", r("s", 2).alias("s"), "hi")


@query("SELECT row_number() OVER (ORDER BY event_type, event_id) - 1 AS index, event_id FROM events")
def row_index_text_key(t):
    return ranges.row_index(t.events.select("event_type", "event_id"), ["event_type", "event_id"]).select("index", "event_id")


@query("SELECT round(quantile_cont(l_extendedprice, 0.1), 4) AS lo, round(quantile_cont(l_extendedprice, 0.5), 4) AS mid, round(quantile_cont(l_extendedprice, 0.99), 4) AS hi FROM lineitem")
def quantiles_whole_order(t):
    found = ranges.quantiles(t.lineitem, "l_extendedprice", [0.1, 0.5, 0.99])
    return t.spark.createDataFrame([tuple(found)], "lo double, mid double, hi double").select(*(r(c).alias(c) for c in ("lo", "mid", "hi")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(product(1 - l_discount) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) + 1e-11, 8) AS p, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_over FROM lineitem")
def cum_prod_reverse_count(t):
    own = t.lineitem.withColumn("k", 1 - F.col("l_discount"))
    return own.select(*LINE, r(windows.cum_prod("k", LINE[1:], ["l_orderkey"]) + 1e-11, 8).alias("p"), windows.cum_count("k", LINE[1:], ["l_orderkey"], reverse=True).alias("left_over"))


EWM = "WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), w AS (SELECT user_id, event_id, i, value AS y FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, 0.5 * e.value + 0.5 * w.y FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1) SELECT event_id, round(y + 1e-7, 4) AS ewm FROM w"


@query(EWM)
def ewm_mean(t):
    return windows.ewm(t.events.select("user_id", "event_id", "value"), "value", 0.5, ["event_id"], ["user_id"], "ewm").select("event_id", r(F.col("ewm") + TIE).alias("ewm"))


@query("WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), p AS (SELECT a.user_id, a.event_id, a.i, b.value AS x, CASE WHEN b.i = 1 THEN pow(0.5, a.i - 1) ELSE 0.5 * pow(0.5, a.i - b.i) END AS w FROM e a JOIN e b ON a.user_id = b.user_id AND b.i <= a.i), m AS (SELECT user_id, event_id, i, sum(w * x) / sum(w) AS mu, sum(w) AS s, sum(w * w) AS s2 FROM p GROUP BY ALL) SELECT p.event_id, CASE WHEN any_value(m.i) = 1 THEN 0.0 ELSE round(sqrt(sum(w * (x - mu) * (x - mu)) / any_value(s) * (any_value(s) * any_value(s) / (any_value(s) * any_value(s) - any_value(s2)))), 3) END AS sd FROM p JOIN m ON p.event_id = m.event_id GROUP BY 1")
def ewm_std(t):
    return windows.ewm(t.events.select("user_id", "event_id", "value"), "value", 0.5, ["event_id"], ["user_id"], None, "sd").select("event_id", r("sd", 3).alias("sd"))


@query("SELECT event_id, lag(value) OVER w AS back, lead(value, 2) OVER w AS ahead, round(value - lag(value) OVER w, 4) AS diff, CASE WHEN lag(value) OVER w <> 0 THEN round((value - lag(value) OVER w) / lag(value) OVER w, 4) END AS pct FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def shift_diff_pct(t):
    o, p = ["event_id"], ["user_id"]
    return t.events.select("event_id", windows.shift("value", 1, o, p).alias("back"), windows.shift("value", -2, o, p).alias("ahead"), r(windows.diff("value", 1, o, p)).alias("diff"), r(windows.pct_change("value", 1, o, p)).alias("pct"))


@query(f"SELECT event_id, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY event_type ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2 END AS rk FROM {GAP}")
def rank_average(t):
    return gapped(t).select("event_id", windows.rank("v", ["event_type"]).alias("rk"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) > 1 AS dup, count(*) OVER (PARTITION BY o_custkey) = 1 AS uniq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS fst FROM orders")
def duplicated_unique_first(t):
    return t.orders.select("o_orderkey", windows.is_duplicated("o_custkey").alias("dup"), windows.is_unique("o_custkey").alias("uniq"), windows.is_first("o_custkey", ["o_orderkey"]).alias("fst"))


@query("SELECT o_orderkey, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt, first_value(o_orderkey) OVER w AS fv FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)")
def rank_extras(t):
    w = windows.spec(["o_totalprice", "o_orderkey"], ["o_orderstatus"])
    return t.orders.select("o_orderkey", big(F.dense_rank().over(w)).alias("dr"), big(F.ntile(4).over(w)).alias("nt"), F.first("o_orderkey").over(w).alias("fv"))


# --- 2.9 reshaping


@query("SELECT o_orderstatus, coalesce(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 0) > 0 AS has_urgent, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1")
def pivot_count(t):
    names = ["1-URGENT", "5-LOW"]
    n = reshape.pivot(t.orders, ["o_orderstatus"], "o_orderpriority", "o_orderkey", "count", names)
    s = reshape.pivot(t.orders, ["o_orderstatus"], "o_orderpriority", "o_totalprice", "sum", names).select("o_orderstatus", (F.col("1-URGENT") > 0).alias("has_urgent"))
    return n.join(s, "o_orderstatus").select("o_orderstatus", "has_urgent", F.col("1-URGENT").alias("urgent"), F.col("5-LOW").alias("low"))


@query("SELECT c_nationkey, round(avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 4) AS building, round(avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY'), 4) AS machinery FROM customer GROUP BY 1")
def pivot_mean(t):
    out = reshape.pivot(t.customer, ["c_nationkey"], "c_mktsegment", "c_acctbal", "mean", ["BUILDING", "MACHINERY"])
    return out.select("c_nationkey", r("BUILDING").alias("building"), r("MACHINERY").alias("machinery"))


@query("SELECT l_orderkey, l_linenumber, variable, value FROM lineitem UNPIVOT (value FOR variable IN (l_quantity, l_tax))")
def unpivot(t):
    return reshape.unpivot(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])


@query("SELECT 'r_name' AS \"column\", " + ", ".join(f"max(r_name) FILTER (r_regionkey = {k}) AS column_{k}" for k in range(5)) + " FROM region")
def transpose(t):
    return reshape.transpose(t.region, "r_regionkey", ["r_name"])


@query("SELECT 'r_name' AS field, " + ", ".join(f"max(r_name) FILTER (r_regionkey = {k}) AS {x}" for k, x in enumerate("abcde")) + " FROM region")
def transpose_named(t):
    return reshape.transpose(t.region, "r_regionkey", ["r_name"], header="field", column_names=list("abcde"))


@query("SELECT doc_id, unnest(string_split(text, '. ')) AS part FROM documents")
def explode_split(t):
    return reshape.explode(t.documents.select("doc_id", strings.split(F.col("text"), ". ").alias("part")), "part")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id FROM events")
def unnest_struct(t):
    own = t.events.select("event_id", strings.json_decode(F.col("props"), "k bigint").alias("s"), "user_id")
    return reshape.unnest(own, ["s"])


# --- 2.10 mathematics


@query("SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_size), 8) AS sq, round(ln(p_size), 8) AS ln, round(log10(p_size), 8) AS lg, round(exp(p_size / 10), 5) AS ex, round(sin(p_size), 8) AS si, round(cos(p_size), 8) AS co, round(tan(p_size), 6) AS ta FROM part")
def math_functions(t):
    x = F.col("p_size")
    return t.part.select("p_partkey", F.abs(x - 25).alias("a"), r(scalar.sqrt(x), 8).alias("sq"), r(scalar.log(x), 8).alias("ln"), r(scalar.log10(x), 8).alias("lg"), r(F.exp(x / 10), 5).alias("ex"), r(F.sin(x), 8).alias("si"), r(F.cos(x), 8).alias("co"), r(F.tan(x), 6).alias("ta"))


@query("SELECT p_partkey, floor(p_retailprice / 7) AS fl, ceil(p_retailprice / 7) AS ce, least(greatest(p_size, 10), 30) AS cl, round_even(p_size / 8, 1) AS ev FROM part")
def floor_ceil_clip_round(t):
    p = F.col("p_retailprice") / 7
    return t.part.select("p_partkey", scalar.floor(p).alias("fl"), scalar.ceil(p).alias("ce"), scalar.clip(F.col("p_size"), 10, 30).alias("cl"), scalar.round_even(F.col("p_size") / 8, 1).alias("ev"))


@query("SELECT event_id, CASE WHEN value > 50 THEN 'finite' WHEN value = 50 THEN '-inf' ELSE 'nan' END AS kind FROM events")
def log_ieee(t):
    x = scalar.log(F.col("value") - 50)
    return t.events.select("event_id", F.when(F.isnan(x), "nan").when(x == -scalar.INF, "-inf").otherwise("finite").alias("kind"))


@query("SELECT p_partkey, CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(p_name) + 1), lambda i: ascii(p_name[i])::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS VARCHAR) AS h FROM part")
def hash_fnv1a(t):
    return t.part.select("p_partkey", udf.fnv1a(F.col("p_name")).cast("string").alias("h"))


@query("SELECT c_custkey, CASE WHEN c_custkey = 0 THEN 0 ELSE (1023 + CAST(floor(log2(c_custkey)) AS BIGINT)) * 4503599627370496 + CAST((c_custkey / pow(2, floor(log2(c_custkey))) - 1) * 4503599627370496 AS BIGINT) END AS bits, true AS back FROM customer")
def reinterpret_bits(t):
    """The bits of whole numbers as doubles, and back."""
    bits = udf.reinterpret(F.col("c_custkey").cast("double"), "double", "bigint")
    own = t.customer.select("c_custkey", bits.alias("bits"))
    return own.select("c_custkey", "bits", (udf.reinterpret(F.col("bits"), "bigint", "double") == F.col("c_custkey")).alias("back"))


# --- 2.11 strings


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n, contains(text, 'the') AS c, starts_with(text, 'The') AS s, ends_with(text, '.') AS e, regexp_matches(text, '[0-9]{3}') AS m FROM documents")
def string_tests(t):
    x = F.col("text")
    return t.documents.select("doc_id", big(strings.byte_lengths(x)).alias("n"), strings.contains(x, "the").alias("c"), strings.starts_with(x, "The").alias("s"), strings.ends_with(x, ".").alias("e"), strings.regex_match(x, "[0-9]{3}").alias("m"))


@query("SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, reverse(p_type) AS v, regexp_replace(p_name, 'a', 'A') AS one, replace(p_name, 'a', 'A') AS every FROM part")
def string_transforms(t):
    n = F.col("p_name")
    return t.part.select("p_partkey", strings.upper(n).alias("u"), strings.lower(F.col("p_brand")).alias("l"), strings.reverse(F.col("p_type")).alias("v"), strings.replace(n, "a", "A").alias("one"), strings.replace_all(n, "a", "A").alias("every"))


@query("SELECT n_nationkey, substring(n_name, 2, 3) AS mid, left(n_name, 2) AS hd, right(n_name, 2) AS tl, CASE WHEN length(n_name) >= 12 THEN n_name ELSE lpad(n_name, 12, '*') END AS ps, CASE WHEN length(n_name) >= 12 THEN n_name ELSE rpad(n_name, 12, '.') END AS pe, trim('  ' || n_name || ' ') AS st FROM nation")
def string_slices(t):
    n = F.col("n_name")
    return t.nation.select("n_nationkey", strings.slice_(n, 1, 3).alias("mid"), strings.head(n, 2).alias("hd"), strings.tail(n, 2).alias("tl"), strings.pad_start(n, 12, "*").alias("ps"), strings.pad_end(n, 12, ".").alias("pe"), strings.strip(F.concat(F.lit("  "), n, F.lit(" "))).alias("st"))


@query("SELECT page_id, regexp_extract(url, '[a-z0-9.]+[.](com|net|org)', 0) AS host, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n FROM pages")
def string_extract(t):
    return t.pages.select("page_id", strings.extract(F.col("url"), "[a-z0-9.]+[.](com|net|org)").alias("host"), big(F.size(strings.extract_all(F.col("html"), "<p>"))).alias("n"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, date_trunc('second', o_orderdate) AS ts FROM orders")
def string_dates(t):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return t.orders.select("o_orderkey", strings.to_date(F.left(text, F.lit(10))).alias("d"), strings.to_datetime(text).alias("ts"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(to_json(event_type) AS VARCHAR) AS j FROM events")
def json_codec(t):
    return t.events.select("event_id", strings.json_decode(F.col("props"), "k bigint")["k"].alias("k"), strings.json_encode(F.col("event_type")).alias("j"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS title FROM part")
def string_title(t):
    return t.part.select("p_partkey", strings.title(F.col("p_name")).alias("title"))


# --- 2.12 binary


@query("SELECT n_nationkey, CAST(octet_length(encode(n_name)) AS BIGINT) AS n, lower(hex(encode(n_name))) AS hx, base64(encode(n_name)) AS b64, contains(n_name, 'AN') AS c, starts_with(n_name, 'A') AS s, ends_with(n_name, 'A') AS e, n_name AS back FROM nation")
def binary_functions(t):
    b = F.col("n_name").cast("binary")
    return t.nation.select("n_nationkey", big(binary.lengths(b)).alias("n"), binary.encode(b, "hex").alias("hx"), binary.encode(b, "base64").alias("b64"), binary.contains(b, b"AN").alias("c"), binary.starts_with(b, b"A").alias("s"), binary.ends_with(b, b"A").alias("e"), binary.decode(binary.decode(binary.encode(b, "hex"), "hex"), "utf-8").alias("back"))


# --- 2.13 time


@query("SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, isodow(ts) AS wd, quarter(ts) AS q, dayofyear(ts) AS od, (epoch_us(ts) % 1000000) * 1000 AS ns FROM events")
def temporal_parts(t):
    x = F.col("ts")
    parts = {"y": temporal.year, "mo": temporal.month, "d": temporal.day, "h": temporal.hour, "mi": temporal.minute, "s": temporal.second, "wd": temporal.weekday, "q": temporal.quarter, "od": temporal.ordinal_day, "ns": temporal.nanosecond}
    return t.events.select("event_id", *(big(f(x)).alias(k) for k, f in parts.items()))


@query("SELECT event_id, make_timestamp(epoch_us(ts) + 95400000000) AS off, make_timestamp((epoch_us(ts) // 900000000) * 900000000) AS tr, make_timestamp(((epoch_us(ts) + 450000000) // 900000000) * 900000000) AS rd, make_timestamp(epoch_us(ts) - 1800000000) AS sub FROM events")
def temporal_arithmetic(t):
    x = F.col("ts")
    return t.events.select("event_id", temporal.offset_by(x, "1d2h30m").alias("off"), temporal.truncate(x, "15m").alias("tr"), temporal.round_(x, "15m").alias("rd"), temporal.subtract_duration(x, "30m").alias("sub"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us, epoch_us(ts) * 1000 AS ns, CAST(date_trunc('month', ts) AS DATE) AS ms1, last_day(ts) AS me, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin' AS berlin FROM events")
def temporal_epoch_zone(t):
    x = F.col("ts")
    return t.events.select("event_id", *(temporal.epoch(x, u).alias(u) for u in ("s", "ms", "us", "ns")), temporal.month_start(x).alias("ms1"), temporal.month_end(x).alias("me"), temporal.convert_time_zone(x, "Europe/Berlin").alias("berlin"))


@query("SELECT event_id, date_trunc('second', ts) AS s, date_trunc('millisecond', ts) AS ms, epoch_us(ts) * 1000 AS ns, epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS since FROM events")
def temporal_units(t):
    x = F.col("ts")
    since = temporal.unix_micros(x) - temporal.unix_micros(temporal.truncate(x, "1d"))
    return t.events.select("event_id", temporal.cast_time_unit(x, "s").alias("s"), temporal.cast_time_unit(x, "ms").alias("ms"), temporal.timestamp(x, "ns").alias("ns"), since.alias("since"))


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0, 6) AS d, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0, 6) AS h, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE AS s FROM events")
def temporal_totals(t):
    zero = F.lit("2024-01-01").cast("timestamp_ntz")
    return t.events.select("event_id", r(temporal.total(F.col("ts"), zero, "days"), 6).alias("d"), r(temporal.total(F.col("ts"), zero, "hours"), 6).alias("h"), temporal.total(F.col("ts"), zero, "seconds").alias("s"))


@query("SELECT event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us FROM events")
def temporal_subtract(t):
    gap = temporal.subtract(F.col("ts"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return t.events.select("event_id", temporal.interval_micros(gap).alias("us"))


# --- 2.14 lists and structs

EMB = "(SELECT vec_id, embedding AS e FROM embeddings)"


def _emb(t):
    return t.embeddings.select("vec_id", F.col("embedding").alias("e"))


@query(f"SELECT vec_id, CAST(len(e) AS BIGINT) AS n, round(list_sum(e::DOUBLE[]), 4) AS s, round(list_avg(e::DOUBLE[]), 5) AS m, list_min(e) AS lo, list_max(e) AS hi, e[1] AS fst, e[-1] AS lst, e[100] AS none FROM {EMB}")
def list_aggregates(t):
    e = F.col("e")
    return _emb(t).select("vec_id", big(lists.lengths(e)).alias("n"), r(lists.sum_(e), 4).alias("s"), r(lists.mean(e), 5).alias("m"), lists.min_(e).alias("lo"), lists.max_(e).alias("hi"), lists.get(e, 0).alias("fst"), lists.get(e, -1).alias("lst"), lists.get(e, 99).alias("none"))


WORDS = "(SELECT doc_id, string_split(text, ' ') AS w FROM documents)"


@query(f"SELECT doc_id, list_contains(w, 'the') AS c, array_to_string(w, '|') AS j, array_to_string(list_sort(w), '|') AS so, array_to_string(list_reverse(w), '|') AS rv, array_to_string(list_transform(w, lambda x: lower(x)), '|') AS ev, array_to_string(w[3:4], '|') AS sl, CAST(list_unique(w) AS BIGINT) AS un FROM {WORDS}")
def list_transforms(t):
    w = F.col("w")
    own = t.documents.select("doc_id", strings.split(F.col("text"), " ").alias("w"))
    return own.select("doc_id", lists.contains(w, "the").alias("c"), lists.join(w, "|").alias("j"), lists.join(lists.sort(w), "|").alias("so"), lists.join(lists.reverse(w), "|").alias("rv"), lists.join(lists.eval_(w, F.lower), "|").alias("ev"), lists.join(lists.slice_(w, 2, 2), "|").alias("sl"), big(lists.lengths(lists.unique(w))).alias("un"))


@query(f"SELECT vec_id, CAST(list_position(e, list_min(e)) - 1 AS BIGINT) AS lo, CAST(list_position(e, list_max(e)) - 1 AS BIGINT) AS hi, array_to_string(list_transform(list_prepend(NULL, e[:-2]), lambda x: coalesce(CAST(round(x::DOUBLE, 4) * 10000 AS BIGINT), 0)), ' ') AS sh, array_to_string(list_transform(range(1, len(e) + 1), lambda i: CASE WHEN i = 1 THEN 0 ELSE CAST(round((e[i]::DOUBLE - e[i - 1]::DOUBLE) * 1000) AS BIGINT) END), ' ') AS df FROM {EMB}")
def list_arg_diff_shift(t):
    e = F.col("e")
    own = _emb(t).withColumn("d", F.transform("e", lambda x: x.cast("double")))
    whole = lambda c, f: lists.join(F.transform(c, lambda x: F.coalesce(F.round(f(x)).cast("long"), F.lit(0)).cast("string")), " ")
    return own.select("vec_id", big(lists.arg_min(e)).alias("lo"), big(lists.arg_max(e)).alias("hi"), whole(lists.shift(F.col("d"), 1), lambda x: F.round(x, 4) * 10000).alias("sh"), whole(lists.diff(F.col("d"), 1), lambda x: x * 1000).alias("df"))


@query("SELECT vec_id, CAST(64 AS BIGINT) AS n, e[64] AS lst FROM " + EMB)
def array_fixed_width(t):
    e = lists.fixed_width(F.col("e"), 64)
    return _emb(t).select("vec_id", big(lists.lengths(e)).alias("n"), lists.get(e, 63).alias("lst"))


@query("SELECT c_custkey, c_name AS label, c_acctbal * 2 AS twice, '{\"label\":\"' || c_name || '\",\"none\":null}' AS j FROM customer")
def struct_functions(t):
    s = F.struct("c_name", "c_acctbal")
    own = t.customer.select("c_custkey", lists.with_fields(lists.rename_fields(s, ["c_name", "c_acctbal"], ["label", "balance"]), twice=F.col("c_acctbal") * 2).alias("s"))
    small = lists.struct_json(F.struct(lists.field(F.col("s"), "label").alias("label"), F.lit(None).cast("string").alias("none")))
    return own.select("c_custkey", lists.field(F.col("s"), "label").alias("label"), F.col("s.twice").alias("twice"), small.alias("j"))


@query("SELECT page, array_to_string(list_sort(map_keys(m)), ',') AS ks, CAST(cardinality(m) AS BIGINT) AS n, m['b'] AS b, m['zz'] AS none, map_contains(m, 'a') AS has FROM (SELECT page_id AS page, MAP {'a': page_id, 'b': page_id * 2, 'c': page_id * 3} AS m FROM pages)")
def map_functions(t):
    k = F.col("page_id")
    m = maps.merge(maps.from_lists(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(k * 0, k, k * 3)), F.create_map(F.lit("a"), k))
    m = maps.filter_(maps.merge(m, maps.map_values(F.create_map(F.lit("b"), k), lambda v: v * 2)), lambda x, _: x != "z")
    own = t.pages.select(F.col("page_id").alias("page"), m.alias("m"))
    return own.select("page", lists.join(lists.sort(maps.keys(F.col("m"))), ",").alias("ks"), maps.lengths(F.col("m")).alias("n"), maps.get(F.col("m"), "b").alias("b"), maps.get(F.col("m"), "zz").alias("none"), maps.contains(F.col("m"), "a").alias("has"))


# --- enums, categories, times of day

RANKED = ["5-LOW", "3-MEDIUM", "1-URGENT"]


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('5-LOW', '3-MEDIUM', '1-URGENT') THEN o_orderpriority END AS value, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 END AS code, CASE WHEN o_orderpriority IN ('5-LOW', '3-MEDIUM', '1-URGENT') THEN o_orderpriority END AS back FROM orders")
def enum_values(t):
    c = F.col("o_orderpriority")
    own = t.orders.select("o_orderkey", categories.enum_cast(c, RANKED).alias("value"), categories.enum_code(c, RANKED).alias("code"))
    return own.withColumn("back", categories.enum_value(F.col("code"), RANKED))


@query("WITH f AS (SELECT c_mktsegment, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS code FROM customer GROUP BY 1) SELECT c_custkey, code FROM customer JOIN f USING (c_mktsegment)")
def categorical_codes(t):
    return categories.categorical(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", ["c_custkey"], "code").select("c_custkey", "code")


@query("SELECT event_id, (epoch_us(ts) % 86400000000) * 1000 AS t, hour(ts) AS h, minute(ts) AS m, second(ts) AS s, ((epoch_us(ts) % 86400000000) * 1000 + 79200000000000) % 86400000000000 AS later, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) * 1000000000 AS made FROM events")
def time_of_day(t):
    own = t.events.select("event_id", categories.time_of_day(F.col("ts")).alias("t"))
    h, m, s = (f(F.col("t")) for f in (categories.time_hour, categories.time_minute, categories.time_second))
    return own.select("event_id", "t", h.alias("h"), m.alias("m"), s.alias("s"), categories.add_to_time(F.col("t"), F.lit(22 * 3600 * categories.SECOND)).alias("later"), categories.make_time(h, m, s).alias("made"))


# --- 2.15 user functions


@query("SELECT n_nationkey, CAST(length(n_name) * 3 AS BIGINT) AS x FROM nation")
def map_elements(t):
    return t.nation.select("n_nationkey", udf.map_elements(F.col("n_name"), lambda s: len(s) * 3, "bigint").alias("x"))


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders")
def map_batches(t):
    return udf.map_batches(t.orders.select("o_orderkey", "o_totalprice"), lambda p: p.assign(twice=p.o_totalprice * 2)[["o_orderkey", "twice"]], "o_orderkey long, twice double")


@query("SELECT c_mktsegment, round(max(c_acctbal) - min(c_acctbal), 2) AS spread FROM customer GROUP BY 1")
def registered_aggregate(t):
    udf.register_aggregate(t.spark, "loomwork_spread", lambda s: float(s.max() - s.min()), "double")
    t.customer.createOrReplaceTempView("loomwork_customer")
    return t.spark.sql("SELECT c_mktsegment, round(loomwork_spread(c_acctbal), 2) AS spread FROM loomwork_customer GROUP BY 1")


class _Letters:
    def eval(self, text: str):
        for k, c in enumerate(text or ""):
            yield k, c


@query("SELECT n_nationkey, i AS place, n_name[i + 1] AS letter FROM (SELECT n_nationkey, n_name, CAST(unnest(range(length(n_name))) AS INT) AS i FROM nation)")
def registered_table_function(t):
    udf.register_table_function(t.spark, "loomwork_letters", _Letters, "place int, letter string")
    t.nation.createOrReplaceTempView("loomwork_nation")
    return t.spark.sql("SELECT n_nationkey, place, letter FROM loomwork_nation, LATERAL loomwork_letters(n_name)")


# --- 2.1, 2.2 sources, 2.16 streams


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def scan_sql(t):
    t.customer.createOrReplaceTempView("loomwork_customer")
    return files.scan_sql(t.spark, "SELECT c_mktsegment, count(*) AS n FROM loomwork_customer GROUP BY 1")


CUSTOMERS = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(t):
    path = work_path(t.spark, "csv")
    files.write_csv(t.customer, path, sep=";")
    return files.scan_csv(t.spark, path, CUSTOMERS, sep=";")


@query("SELECT p_partkey, try_cast(CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS BIGINT) AS size, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS price FROM part")
def csv_bad_values(t):
    """A value that is none of its column's type is null, the row stays."""
    path, k = work_path(t.spark, "csv"), F.col("p_partkey")
    files.write_csv(t.part.select(k, F.when(k % 3 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("size"), F.when(k % 5 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("price")), path)
    return files.scan_csv(t.spark, path, "p_partkey long, size long, price double")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0")
def json_round_trip(t):
    path = work_path(t.spark, "json")
    files.write_json(t.customer, path)
    return files.scan_json(t.spark, path, CUSTOMERS).where("c_acctbal > 0")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def parquet_partitioned(t):
    path = work_path(t.spark, "parquet")
    files.write_parquet(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus").repartition("o_orderstatus", F.pmod("o_orderkey", F.lit(8))), path, ["o_orderstatus"])
    return files.scan_parquet(t.spark, path).where("o_orderstatus = 'F'")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM part")
def ipc_sink(t):
    path = work_path(t.spark, "ipc")
    return files.write_ipc(t.part, path).agg(F.sum("rows").alias("n"))


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def ipc_round_trip(t):
    path = work_path(t.spark, "ipc")
    files.write_ipc(t.part.select("p_partkey", "p_name", "p_size", "p_retailprice"), path).count()
    return files.scan_ipc(t.spark, path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_with_mark(t):
    path = work_path(t.spark, "csv")
    files.write_csv(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path, bom=True)
    return files.scan_csv(t.spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_array_files(t):
    path = work_path(t.spark, "json")
    files.write_json(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path, ndjson=False)
    return files.scan_json(t.spark, path, "n_nationkey int, n_name string, n_regionkey int", array=True)


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 40")
def sql_database(t):
    """A table in a SQLite file in the shared folder, read back with projection and limit pushed into the query's text."""
    import os
    import sqlite3
    import tempfile
    import uuid

    base = work_path(t.spark, "database").removeprefix("file:")
    if "://" in base:  # SQLite reads files only
        base = f"{tempfile.gettempdir()}/{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(base), exist_ok=True)
    with sqlite3.connect(path := f"{base}.db") as c:
        c.execute("CREATE TABLE supplier (s_suppkey INTEGER, s_name TEXT, s_acctbal REAL)")
        for b in files.batches(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), 1000):
            c.executemany("INSERT INTO supplier VALUES (?, ?, ?)", zip(*(x.to_pylist() for x in b.columns)))
    return files.read_sql(t.spark, "SELECT * FROM supplier ORDER BY s_suppkey;", "sqlite", path, ["s_suppkey", "s_name"], 40, 10)


@query("SELECT r_regionkey, r_name FROM region")
def from_cursor(t):
    class Cursor:
        def __init__(self, rows):
            self.rows = rows

        def fetchmany(self, n):
            out, self.rows = self.rows[:n], self.rows[n:]
            return out

    rows = [tuple(x) for x in t.region.select("r_regionkey", "r_name").collect()]
    return files.from_cursor(t.spark, Cursor(rows), "r_regionkey long, r_name string", 2)


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(n_nationkey) AS BIGINT) AS keys, true AS bounded FROM nation")
def collect_batches(t):
    """Batches on the driver, and the same by a future."""
    own = t.nation.select(big("n_nationkey").alias("n_nationkey"))
    got = list(files.batches(own, 7))
    table = files.collect_async(own).result()
    return t.spark.createDataFrame([(sum(b.num_rows for b in got), sum(sum(b.column(0).to_pylist()) for b in got), max(b.num_rows for b in got) <= 7 and table.num_rows == sum(b.num_rows for b in got))], "rows long, keys long, bounded boolean")


@query("SELECT CAST(count(*) AS BIGINT) AS rows, true AS timed FROM region")
def profile(t):
    table, phases = files.profile(t.region.orderBy("r_regionkey"))
    return t.spark.createDataFrame([(table.num_rows, phases["execution"] > 0 and "planning" in phases)], "rows long, timed boolean")


@query("SELECT r_regionkey AS k, r_name AS name FROM region")
def to_dict(t):
    held = files.to_dict(t.region.select("r_regionkey", "r_name"))
    return files.from_rows(t.spark, list(zip(held["r_regionkey"], held["r_name"])), "k long, name string")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def arrow_round_trip(t):
    return files.from_arrow(t.spark, files.to_arrow(t.nation))


@query("SELECT '[' || string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}', ',' ORDER BY r_regionkey) || ']' AS json FROM region")
def json_array(t):
    return files.json_array(t.region.select("r_regionkey", "r_name"), ["r_regionkey"])


@query("SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS window_start, event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1, 2")
def stream_tumbling(t):
    live = stream.tumbling(stream.event_time(t.live("events"), "ts"), "ts", "6 hours", ["event_type"], {"n": F.count(F.lit(1)), "users": F.sum("user_id")})
    out = stream.run_to_table(live, work_path(t.spark, "windows"), work_path(t.spark, "progress"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicated(t):
    live = stream.event_time(t.live("events").select("user_id", "event_type", "ts"), "ts", "1 day")
    out = stream.run_to_table(stream.deduplicated(live, ["user_id", "event_type"]), work_path(t.spark, "seen"), work_path(t.spark, "progress"), "append")
    return out.select("user_id", "event_type")


@query("SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_batch(t):
    out = stream.tumbling(stream.event_time(t.events, "ts"), "ts", "6 hours", ["event_type"], {"n": F.count(F.lit(1))})
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 86400000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions_batch(t):
    out = stream.sessions(stream.event_time(t.events, "ts"), "ts", "1 day", ["user_id"], {"n": F.count(F.lit(1))})
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


# --- composite workloads


@query("WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT day, round(total, 2) AS total, CASE WHEN count(*) OVER w >= 7 THEN round(avg(total) OVER w, 2) END AS week FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def daily_rolling(t):
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    w = Window.orderBy("day").rowsBetween(-6, 0)  # one row a day, so one task
    return daily.select("day", r("total", 2).alias("total"), r(F.when(F.count("total").over(w) >= 7, F.avg("total").over(w)), 2).alias("week"))


@query("SELECT l_shipdate, round(sum(l_extendedprice * l_discount) + 1e-7, 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 GROUP BY 1")
def revenue_by_day(t):
    own = t.lineitem.where("l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
    return own.groupBy("l_shipdate").agg(r(F.sum(F.col("l_extendedprice") * F.col("l_discount")) + TIE, 2).alias("revenue"))
