"""Operators on tiny frames with expected values, file round trips, plans and streams."""

import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwork.functions import lists, scalar, strings, temporal, udf
from loomwork.operators import frame, grouping, joins, ranges, reshape, stats, windows
from loomwork.sources import files, sqlite
from loomwork.streaming import windows as stream

DATA = "/root/testdata/sf0.001"


def col(df, name, by):
    return [r[name] for r in df.orderBy(by).collect()]


def test_fill_strategies(spark):
    df = spark.createDataFrame([(0, 1), (1, None), (2, 3), (3, None), (4, None)], "i int, a int")
    assert col(df.withColumn("x", windows.fill_forward("a", ["i"])), "x", "i") == [1, 1, 3, 3, 3]
    assert col(df.withColumn("x", windows.fill_backward("a", ["i"])), "x", "i") == [1, 3, 3, None, None]
    assert col(ranges.fill_forward(df, "a", ["i"], "x"), "x", "i") == [1, 1, 3, 3, 3]
    assert col(df.withColumn("x", windows.fill_with(F.max, "a")), "x", "i") == [1, 3, 3, 3, 3]


def test_asof(spark):
    left = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "time int, val_l int")
    right = spark.createDataFrame([(5, 50), (15, 150), (25, 250)], "time int, val_r int")
    got = lambda **k: col(joins.asof(left, right, "time", **k), "val_r", "time")
    assert got() == [50, 150, 250]
    assert got(strategy="forward") == [150, 250, None]
    assert got(strategy="nearest") == [50, 150, 250]
    assert got(tolerance=4) == [None, None, None]


@pytest.mark.parametrize("spread", [True, False])
@pytest.mark.parametrize("strategy", ["backward", "forward", "nearest"])
def test_asof_null_keys_and_hot_keys(spark, spread, strategy, monkeypatch):
    monkeypatch.setattr(ranges, "LEAST", 5)
    draw = __import__("random").Random(7)
    some = lambda x: None if draw.random() < 0.1 else x
    left = [(i, some(draw.randrange(400)), some("a" if draw.random() < 0.7 else "b")) for i in range(120)]
    right = [(100 + i, some(draw.randrange(400)), some("a" if draw.random() < 0.7 else "c")) for i in range(60)]
    l = spark.createDataFrame(left, "i int, t int, g string")  # noqa: E741
    r = spark.createDataFrame(right, "i int, t int, g string")
    got = {x.i: x.i_right for x in joins.asof(l, r, "t", ["g"], strategy=strategy, right_order_by=["i"], spread=spread).collect()}
    for i, t, g in left:
        same = [(u, j) for j, u, h in right if None not in (t, g, u, h) and g == h]
        back, ahead = [x for x in same if x[0] <= t] if same else [], [x for x in same if x[0] >= t] if same else []
        b, a = max(back, default=None), min(ahead, default=None)
        want = {"backward": b, "forward": a, "nearest": a if b is None else b if a is None or t - b[0] <= a[0] - t else a}[strategy]
        assert got[i] == (want and want[1]), (i, t, g)


def test_joined_names_are_free(spark):
    own = spark.createDataFrame([(1, 2)], "k int, v int")
    out = joins.join(joins.join(joins.join(own, own, "k"), own, "k"), own.withColumnRenamed("v", "v_right"), "k")
    assert out.columns == ["k", "v", "v_right", "v_right2", "v_right_right"] and out.first().v_right2 == 2


def test_helper_names_do_not_clash(spark):
    df = spark.createDataFrame([(0, 1, 5), (10, 2, 6)], "t long, __x int, __rank int")
    assert grouping.rolling(df, "t", 10, {"n": F.count(F.lit(1))}).columns == ["t", "__x", "__rank", "n"]
    assert frame.unique(df, ["__x"], ["t"]).columns == df.columns
    own = spark.createDataFrame([(2, 1, 1, 1, 1)], "k int, __range int, __total0 int, __before0 int, __local0 int")
    assert [tuple(x) for x in ranges.row_index(own, ["k"]).collect()] == [(0, 2, 1, 1, 1, 1)]


def test_ranges_of_any_key(spark, monkeypatch):
    """Text keys, nulls, times, and a first key that nearly all rows share; many ranges and few."""
    rows = [(None if i % 11 == 0 else "same" if i % 3 else f"k{i % 17}", i) for i in range(1500)]
    df = spark.createDataFrame(rows, "s string, i int").withColumn("ts", F.timestamp_seconds(F.col("i") % 100).cast("timestamp_ntz"))
    for least in (3, 60):
        monkeypatch.setattr(ranges, "LEAST", least)
        part = ranges.ranged(df, ["s", "i"], "part").groupBy("part").count().collect()
        assert max(r["count"] for r in part) < 1500 / least * 4
        want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
        assert [(r.s, r.i) for r in ranges.row_index(df, ["s", "i"]).orderBy("index").collect()] == want
        assert [r.i for r in ranges.row_index(df, ["ts", "i"]).orderBy("index").collect()] == sorted(range(1500), key=lambda i: (i % 100, i))
        moved = {r.k: r.i for r in frame.shift_columns(df.withColumn("k", F.col("i")), 3, ["i"], ["k"]).collect()}
        assert moved == {i: i - 3 if i > 2 else None for i in range(1500)}
    assert ranges.quantiles(df, "i", [0, 0.25, 1]) == [0, 374.75, 1499] and ranges.quantiles(df.limit(0), "i", [0.5]) == [None]


def test_samples(spark):
    df = spark.range(50)
    again = frame.sample(df, 200, ["id"], with_replacement=True)
    assert again.count() == 200 and 30 < again.distinct().count() <= 50 and again.collect() == again.collect()
    assert frame.sample(df, 80, ["id"]).count() == 50 and frame.sample(df.limit(0), 5, ["id"], with_replacement=True).count() == 0


def test_sql_texts():
    assert files.sql_text("SELECT 1;", "sqlserver", ["a]b"], 5) == "SELECT TOP (5) [a]]b] FROM (SELECT 1) AS q"
    assert files.sql_text("SELECT 1", "postgresql", limit=3) == "SELECT * FROM (SELECT 1) AS q LIMIT 3"
    assert files.sql_text("SELECT 1", "oracle", ["x"], 3) == 'SELECT "x" FROM (SELECT 1) q FETCH FIRST 3 ROWS ONLY'
    assert files.sql_text(" SELECT 1 ; ") == "SELECT 1"
    with pytest.raises(ValueError):
        files.sql_text("SELECT 1", "other", limit=1)


def test_deduplication_drops_old_state(spark, tmp_path):
    """A key seen again after the watermark has passed is new, as its state is gone."""
    for k, rows in enumerate(([(1, 0), (1, 10), (2, 20)], [(9, 100_000)], [(9, 100_001), (1, 100_100)])):
        df = spark.createDataFrame(rows, "k int, s long").selectExpr("k", "timestamp_seconds(s) AS ts").coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/in")
        live = stream.event_time(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "ts", "1 minute")
        stream.run_to_table(stream.deduplicated(live, ["k"]), f"{tmp_path}/out", f"{tmp_path}/progress", "append")
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 1, 2, 9]


def test_outer_join_keeps_both_keys(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"), spark.createDataFrame([(2, 20), (3, 30)], "id int, salary int")
    out = joins.join(left, right, "id", "outer")
    assert out.columns == ["id", "name", "id_right", "salary"] and out.count() == 3
    assert joins.join(left, right, "id", "semi").columns == ["id", "name"]


@pytest.mark.parametrize("closed,want", [("left", {0: 2, 10: 1}), ("right", {0: 2, -10: 1}), ("both", {-10: 1, 0: 3, 10: 1}), ("none", {0: 1})])
def test_dynamic_closed(spark, closed, want):
    df = spark.createDataFrame([(0,), (5,), (10,)], "t long")
    out = grouping.dynamic(df, "t", 10, [F.count(F.lit(1)).alias("n")], closed=closed)
    assert {r.t: r.n for r in out.collect()} == want


@pytest.mark.parametrize("closed,want", [("right", [1, 1, 2]), ("left", [0, 1, 1]), ("both", [1, 2, 2]), ("none", [0, 0, 1])])
def test_rolling_closed(spark, closed, want):
    df = spark.createDataFrame([(0,), (10,), (15,)], "t long")
    assert col(grouping.rolling(df, "t", 10, {"n": F.count(F.lit(1))}, closed), "n", "t") == want


def test_windows_with_nulls(spark):
    df = spark.createDataFrame([(0, 1), (1, None), (2, 2), (3, None), (4, 3)], "i int, a int")
    assert col(df.withColumn("x", windows.cum_prod("a", ["i"])), "x", "i") == [1, None, 2, None, 6]
    assert col(df.withColumn("x", windows.cum_count("a", ["i"])), "x", "i") == [1, 1, 2, 2, 3]
    assert col(df.withColumn("x", windows.rank("a")), "x", "i") == [1, None, 2, None, 3]


def test_ewm(spark):
    df = spark.createDataFrame([(0, 10.0, 1), (1, 20.0, 1), (2, 30.0, 1)], "i int, x double, p int")
    out = windows.ewm(df, "x", 0.5, ["i"], ["p"], "m", "s")
    assert col(out, "m", "i") == [10.0, 15.0, 22.5]
    assert col(out, "s", "i") == pytest.approx([0, 7.0710678, 10.4880885])


def test_row_index_and_cumulative_over_ranges(spark):
    df = spark.range(5000).selectExpr("id % 977 AS k", "id", "CAST(id AS double) AS v")
    assert [(r.k, r.id) for r in ranges.row_index(df, ["k", "id"]).orderBy("index").collect()] == sorted((i % 977, i) for i in range(5000))
    assert ranges.cum_sum(df, "v", ["k", "id"], "s").agg(F.max("s")).first()[0] == sum(range(5000))


def test_reshape(spark):
    df = spark.createDataFrame([(1, 3, 5), (2, 4, 6)], "id int, A int, B int")
    assert {tuple(r) for r in reshape.unpivot(df, ["id"], ["A", "B"]).collect()} == {(1, "A", 3), (2, "A", 4), (1, "B", 5), (2, "B", 6)}
    assert {tuple(r) for r in reshape.transpose(df, "id", ["A", "B"]).collect()} == {("A", 3, 4), ("B", 5, 6)}
    wide = reshape.pivot(spark.createDataFrame([(1, "x", 5), (1, "y", 6), (2, "x", 7)], "d int, c string, v int"), ["d"], "c", "v")
    assert {tuple(r) for r in wide.collect()} == {(1, 5, 6), (2, 7, 0)}
    assert reshape.explode(spark.createDataFrame([([1, 2],), ([],), (None,)], "l array<int>"), "l").count() == 4


def test_hist_of_constant_and_kde_mass(spark):
    assert [tuple(r) for r in stats.hist(spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double"), "x", 5).collect()] == [(2.5, 3.5, 2)]
    rows = stats.kde(spark.range(20).selectExpr("CAST(id AS double) AS x"), "x", 1.0, 200).orderBy("grid").collect()
    assert sum(r.density for r in rows) * (rows[1].grid - rows[0].grid) == pytest.approx(1, abs=0.01)


def test_strings(spark):
    df = spark.createDataFrame([("héllo héllo", "  x　")], "s string, w string")
    got = df.select(strings.byte_lengths(F.col("s")), strings.replace(F.col("s"), "l", "$"), strings.pad_start(F.lit("abcdef"), 3), strings.strip(F.col("w")), strings.json_encode(F.lit('a"b')), strings.slice_(F.lit("hello"), -3, 2)).first()
    assert tuple(got) == (13, "hé$lo héllo", "abcdef", "x", '"a\\"b"', "ll")
    found = strings.json_schema(spark.createDataFrame([('{"a": 1}',), ('{"b": true}',), ("bad",)], "j string"), "j")
    assert "a" in found and "b" in found


def test_lists(spark):
    df = spark.createDataFrame([([1, 1, 2],), ([3, None],), ([],)], "l array<int>")
    c = F.col("l")
    assert [r[0] for r in df.select(lists.sum_(c)).collect()] == [4.0, 3.0, None]
    assert [r[0] for r in df.select(lists.contains(c, 9)).collect()] == [False, False, False]
    assert [r[0] for r in df.select(lists.slice_(c, -2, 5)).collect()] == [[1, 2], [3, None], []]
    assert [r[0] for r in df.select(lists.shift(c, 1)).collect()] == [[None, 1, 1], [None, 3], []]


def test_scalars_and_user_functions(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 1.0)], "a double, b double")
    assert [repr(r[0]) for r in df.select(scalar.true_div(F.col("a"), F.col("b"))).collect()] == ["inf", "-inf", "nan", "None"]
    assert [r[0] for r in df.select(scalar.clip(F.col("a"), 0, 0.5)).collect()] == [0.5, 0.0, 0.0, None]
    assert df.select(udf.reinterpret(F.col("a"), "double", "bigint")).first()[0] == 4607182418800017408
    hashed = spark.createDataFrame([("a",), ("foobar",), (None,), ("",)], "s string").select(udf.fnv1a(F.col("s"))).collect()
    assert [int(r[0]) for r in hashed] == [0xAF63DC4C8601EC8C, 0x85944171F73967E8, 0xCBF29CE484222325, 0xCBF29CE484222325]
    nan = spark.createDataFrame([(float("nan"),), (5.0,), (-5.0,)], "a double")
    assert [repr(r[0]) for r in nan.select(scalar.clip(F.col("a"), -1, 1)).collect()] == ["nan", "1.0", "-1.0"]
    assert [r[0] for r in df.select(udf.map_elements(F.col("a"), lambda x: x + 1, "double")).collect()] == [2.0, 0.0, 1.0, None]


def test_durations():
    assert temporal.micros("1d2h30m") == 95_400_000_000 and temporal.micros("-2s") == -2_000_000 and temporal.micros("7") == 7
    with pytest.raises(ValueError):
        temporal.micros("1parsec")


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', 1.5), (2, None, None)], "i int, s string, x double")
    files.write_csv(df, f"{tmp_path}/c")
    files.write_json(df, f"{tmp_path}/j")
    files.write_parquet(df, f"{tmp_path}/p")
    schema = "i int, s string, x double"
    for back in (files.scan_csv(spark, f"{tmp_path}/c", schema), files.scan_json(spark, f"{tmp_path}/j", schema), files.scan_parquet(spark, f"{tmp_path}/p")):
        assert sorted(map(tuple, back.collect())) == [(1, 'a,"b"', 1.5), (2, None, None)]
    for is_stream in (False, True):
        (tmp_path / f"a{is_stream}").mkdir()
        done = files.write_ipc(df, f"{tmp_path}/a{is_stream}", is_stream).collect()
        opened = (pa.ipc.open_stream if is_stream else pa.ipc.open_file)
        assert sum(opened(r.file).read_all().num_rows for r in done) == 2
    assert files.from_arrow(spark, files.to_arrow(df)).count() == 2
    assert files.to_dict(df)["i"] == [1, 2]
    assert sum(b.num_rows for b in files.batches(df, 1)) == 2 and next(files.batches(df, 1)).num_rows == 1
    for is_stream in (False, True):
        assert sorted(map(tuple, files.scan_ipc(spark, f"{tmp_path}/a{is_stream}").collect())) == [(1, 'a,"b"', 1.5), (2, None, None)]
    files.write_csv(df, f"{tmp_path}/bom", bom=True)
    marked = list((tmp_path / "bom").glob("part-*"))
    assert marked and all(p.read_bytes().startswith(b"\xef\xbb\xbfi,") for p in marked)
    assert sorted(map(tuple, files.scan_csv(spark, f"{tmp_path}/bom", schema).collect())) == [(1, 'a,"b"', 1.5), (2, None, None)]
    files.write_json(df, f"{tmp_path}/arrays", ndjson=False)
    import json

    assert sum(len(json.loads(p.read_text())) for p in (tmp_path / "arrays").glob("part-*")) == 2


def test_sqlite_source(spark, tmp_path):
    with sqlite3.connect(f"{tmp_path}/x.db") as c:
        c.execute("CREATE TABLE e (id INTEGER, name TEXT, pay REAL)")
        c.executemany("INSERT INTO e VALUES (?, ?, ?)", [*((i, f"n{i}", i / 2) for i in range(99)), (None, "none", 1.5)])
    out = sqlite.scan_sqlite(spark, f"{tmp_path}/x.db", "SELECT * FROM e", key="id", low=0, high=100, parts=4)
    assert out.count() == 100 and out.where("id is null").count() == 1 and dict(out.dtypes) == {"id": "bigint", "name": "string", "pay": "double"}


def test_plans(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    text = plan(lines.where("l_quantity > 45").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in text and "l_comment" not in text
    assert "TakeOrderedAndProject" in plan(frame.top_k(lines, "l_quantity", 5))
    assert "BroadcastHashJoin" in plan(joins.join_on(lines, spark.read.parquet(f"{DATA}/supplier.parquet"), ["l_suppkey"], ["s_suppkey"]))


def test_stream_equals_batch(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    make = lambda df: stream.tumbling(stream.event_time(df, "ts", "3650 days"), "ts", "1 day", ["event_type"], {"n": F.count(F.lit(1))})
    got = stream.run_available(make(live), "live_windows", f"{tmp_path}/check", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, make(batch).collect()))


def test_describe_and_missing_counts(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    assert {r.statistic: r.x for r in frame.describe(df, ["x"]).collect()} == {"count": 2, "null_count": 1, "mean": 2, "std": pytest.approx(2**0.5), "min": 1, "25%": 1.5, "50%": 2, "75%": 2.5, "max": 3}
    assert [tuple(r) for r in frame.null_count(df).collect()] == [("x", 1)]
