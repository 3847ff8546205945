"""The bucketed ordered helpers agree with plain windows, also with one hot key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F


def _frame(spark):
    # key 0 holds most rows (a hot key); timestamps spread over several hours
    rows = [(0 if i % 4 else i % 7, i, i * 97 % 1000) for i in range(3000)]
    return spark.createDataFrame(rows, "k int, o int, v int").withColumn(
        "ts", F.timestamp_seconds(F.col("o") * 17))


def test_with_previous_matches_lag(spark):
    from wayline.operators.ordered import with_previous
    df = _frame(spark)
    a = with_previous(df, "k", ["ts", "o"], ["v"], bucket=F.date_trunc("hour", "ts"))
    w = Window.partitionBy("k").orderBy("ts", "o")
    b = df.select("*", F.lag("v").over(w).alias("prev_v"))
    assert a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count()


def test_running_sum_matches_window(spark):
    from wayline.operators.ordered import running_sum
    df = _frame(spark)
    a = running_sum(df, ["k"], ["ts", "o"], ["v"], bucket=F.date_trunc("hour", "ts"))
    w = Window.partitionBy("k").orderBy("ts", "o").rowsBetween(Window.unboundedPreceding, 0)
    b = df.select("*", F.sum("v").over(w).alias("cum_v"))
    assert a.exceptAll(b.select(*a.columns)).count() == 0


def test_top_n_per_group_hot_group(spark):
    from wayline.operators.geo import top_n_per_group
    df = _frame(spark)
    got = top_n_per_group(df, ["k"], ["o"], 3).select("k", "o", "rank")
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("k", "o", F.row_number().over(w).alias("rank")).where(F.col("rank") <= 3)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_rolling_features_halo(spark):
    from wayline.operators.features import rolling_features
    df = _frame(spark)
    r = rolling_features(df, "k", "ts", {"n": "count"}, [30], bucket_minutes=60)
    w = Window.partitionBy("k").orderBy(F.unix_micros(F.col("ts"))).rangeBetween(-30 * 60 * 1_000_000, 0)
    b = df.select("o", F.count(F.lit(1)).over(w).alias("online_n30min"))
    assert r.select("o", "online_n30min").exceptAll(b).count() == 0


def test_numbered_matches_row_number(spark, many_runs):
    from wayline.operators.ordered import numbered
    df = _frame(spark).withColumn("name", F.concat(F.lit("n"), F.md5(F.col("o").cast("string"))))
    for order, key in ((["name"], ["k"]), (["ts", "o"], ["k"]), ([F.col("o").desc()], ["k"]), (["name"], [])):
        got = numbered(df, order, key, "pos")
        w = (Window.partitionBy(*key) if key else Window.partitionBy(F.lit(1))).orderBy(*order)
        want = df.select("*", F.row_number().over(w).cast("bigint").alias("pos"))
        assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0
    with_null = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "k string, o int")
    assert sorted((str(r.k), r.o, r.pos) for r in numbered(with_null, ["o"], ["k"], "pos").collect()) == [("None", 1, 1), ("None", 2, 2), ("a", 5, 1)]
    assert numbered(with_null.where("o > 9"), ["o"], [], "pos").count() == 0


def test_batches_by_text_with_a_hot_shard(spark):
    from wayline.operators.sequence import batch_rows
    df = _frame(spark).withColumn("name", F.md5(F.col("o").cast("string")))
    whole = batch_rows(df, ["name"], 100).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in whole) == [100] * 30
    shards = batch_rows(df, ["name"], 100, shard=F.col("k")).groupBy("k").agg(F.max("row_no").alias("m"), F.count("*").alias("c"))
    assert shards.where("m <> c").count() == 0


@pytest.fixture
def many_runs(spark):
    """Small partitions are not merged, so small tables have several runs."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, old)


def test_merged_segments_match_plain_windows_with_a_third_on_one_trip(spark, many_runs):
    from wayline.functions.geo import haversine_m
    from wayline.operators.ordered import RUN
    from wayline.operators.trajectory import path_segments, trajectory_stats, trip_summary
    p = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("trip"), F.col("id").alias("seq"),
        F.timestamp_seconds(F.col("id") * 31 % 5003 * 60).alias("ts"), (116 + F.col("id") * 37 % 1000 / 2e3).alias("lng"),
        (39 + F.col("id") * 91 % 1000 / 2e3).alias("lat"), F.when(F.col("id") % 7 != 0, F.col("id") % 11 / 2.0).alias("spd"))
    w = Window.partitionBy("trip").orderBy("ts", "seq")

    def plain(x):
        s = haversine_m(F.lag("lng").over(w), F.lag("lat").over(w), "lng", "lat")
        return x.select("trip", s.alias("s"))
    a = {r.trip: r for r in plain(p).groupBy("trip").agg(F.count("*").alias("n"), F.round(F.sum("s"), 3).alias("m"), F.count_if(F.col("s") > 20000).alias("j")).collect()}
    m = {r.trip: r for r in plain(p.where("spd > 2.5")).groupBy("trip").agg(F.count("*").alias("n"), F.round(F.sum("s"), 3).alias("m")).collect()}
    for r in trip_summary(p).collect():
        assert (r.n_points, r.n_moving) == (a[r.trip].n, m[r.trip].n if r.trip in m else 0)
        assert abs(r.path_m - a[r.trip].m) < 0.01 and abs(r.moving_m - (m[r.trip].m if r.trip in m else 0)) < 0.01
    for r in trajectory_stats(p, jump_m=20000.0).collect():
        assert r.n_jumps == a[r.trip].j
    per_run = path_segments(p).groupBy(RUN).agg(F.sum("n").alias("n"), F.max(F.when(F.col("trip") == 0, 1).otherwise(0)).alias("hot")).collect()
    assert sum(r.hot for r in per_run) > 1 and max(r.n for r in per_run) < 3000   # the hot trip is spread
