"""As-of joins and rolling features against brute force, with a hot key, ties and nulls."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from wayline.operators.asof import as_of
from wayline.operators.features import embedding_lookup, rolling_features


def _sides():
    r = random.Random(4)
    key = lambda: 0 if r.random() < 0.6 else r.randrange(1, 9)
    left = [(i, key(), r.randrange(0, 500)) for i in range(900)] + [(900, None, 5), (901, 0, None), (902, 77, 10)]
    right, seen = [], set()
    while len(right) < 700:
        k, t = key(), r.randrange(20, 480)
        if (k, t) not in seen:
            seen.add((k, t))
            right.append((k, t, r.choice([None, t * 10 + k]), f"v{len(right)}" if r.random() < 0.5 else None))
    return left, right + [(None, 3, 1, "x"), (0, None, 2, "y")]


def _brute(left, right, strict):
    out = []
    for i, k, t in left:
        got = []
        for c in (2, 3):
            ok = sorted((x[1], x[c]) for x in right if None not in (k, t, x[1]) and x[0] == k and x[c] is not None
                        and (x[1] < t if strict else x[1] <= t))
            got.append(ok[-1][1] if ok else None)
        out.append((i, k, t, *got))
    return out


@pytest.mark.parametrize("merged", ["true", "false"])
def test_as_of_is_brute_force_with_a_hot_key(spark, merged):
    name = "spark.sql.adaptive.coalescePartitions.enabled"   # "false": small tables have several runs
    old = spark.conf.get(name)
    spark.conf.set(name, merged)
    try:
        _check_as_of(spark)
    finally:
        spark.conf.set(name, old)


def _check_as_of(spark):
    left, right = _sides()
    a = spark.createDataFrame(left, "id long, k int, t long").repartition(3)
    b = spark.createDataFrame(right, "k int, rt long, n long, s string").repartition(3)
    for strict in (False, True):
        got = as_of(a, b, "k", "t", "rt", ["n", "s"], strict)
        assert got.columns == ["id", "k", "t", "n", "s"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(_brute(left, right, strict), key=str)


def test_as_of_with_an_empty_side(spark):
    a = spark.createDataFrame([(1, 2)], "k int, t long")
    b = spark.createDataFrame([], "k int, rt long, n long")
    assert [tuple(r) for r in as_of(a, b, "k", "t", "rt", ["n"]).collect()] == [(1, 2, None)]
    assert as_of(a.where("k > 5"), b, "k", "t", "rt", ["n"]).count() == 0


def test_rolling_features_over_a_dense_key_and_nulls(spark):
    r = random.Random(1)
    rows = [(i, "hot" if i % 3 else f"k{i % 4}", r.randrange(0, 6 * 3600), r.choice([None, r.uniform(-5, 5)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, k string, s long, v double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = rolling_features(df, "k", "ts", {"n": "count", "a": "avg:v", "t": "sum:v"}, [5, 30, 90], bucket_minutes=60)
    got = {x.i: x for x in got.collect()}
    assert len(got) == len(rows)
    by = {}
    for i, k, s, v in rows:
        by.setdefault(k, []).append((s, v))
    by = {k: sorted(x, key=lambda y: y[0]) for k, x in by.items()}
    for i, k, s, _ in rows[::17]:
        times = [x[0] for x in by[k]]
        for h in (5, 30, 90):
            vs = [x[1] for x in by[k][bisect.bisect_left(times, s - h * 60):bisect.bisect_right(times, s)]]
            have = [v for v in vs if v is not None]
            assert got[i][f"online_n{h}min"] == len(vs)
            if have:
                assert abs(got[i][f"online_t{h}min"] - sum(have)) < 1e-9 and abs(got[i][f"online_a{h}min"] - sum(have) / len(have)) < 1e-9
            else:
                assert got[i][f"online_a{h}min"] is None and got[i][f"online_t{h}min"] is None
    none = df.limit(1).withColumn("ts", F.lit(None).cast("timestamp"))
    x = rolling_features(none, "k", "ts", {"n": "count", "a": "avg:v"}, [5]).collect()
    assert [(y.online_n5min, y.online_a5min) for y in x] == [(0, None)]


def test_embedding_lookup_of_wide_short_and_broken_vectors(spark):
    wide = [(1, [1.0] * 1024), (2, [3.0] * 1024), (3, [5.0, None]), (4, []), (5, None)]
    t = spark.createDataFrame(wide, "vec_id long, embedding array<double>")
    d = spark.createDataFrame([(10, [1, 2]), (11, [1, 3]), (12, [3]), (13, [9]), (14, []), (15, None)], "key long, ids array<long>")
    got = {r.key: r.v for r in embedding_lookup(d, "ids", t, "key", "v").collect()}
    assert got[10] == [2.0] * 1024 and got[11][:3] == [3.0, 1.0, 1.0] and len(got[11]) == 1024
    assert got[12] == [5.0, None] and got[13] is None and got[14] is None and got[15] is None
    one = spark.createDataFrame([(10, 3), (11, 9)], "key long, id long")
    assert {r.key: r.v for r in embedding_lookup(one, "id", t, "key", "v").collect()} == {10: [5.0, None], 11: None}


def test_chunks_decode_apart_and_join_to_the_whole_text(spark):
    from wayline.operators.polyline import decode_chunks, encode_chunks, encode_polylines
    r = random.Random(6)
    rows = [(0 if i % 3 == 0 else i % 9, i, r.uniform(116, 117), r.uniform(39, 40)) for i in range(900)]
    p = spark.createDataFrame(rows, "trip int, seq int, lng double, lat double").withColumn("ts", F.timestamp_seconds(F.col("seq")))
    c = encode_chunks(p, size=32).cache()
    assert c.agg(F.max("n")).first()[0] == 32 and c.where("trip = 0").count() > 9
    text = {x.trip: x.text for x in encode_polylines(p).collect()}
    joined = {}
    for x in sorted(c.collect(), key=lambda x: (x.trip, x.chunk)):
        joined[x.trip] = joined.get(x.trip, "") + x.text
    assert joined == text
    got = {(x.trip, x.chunk, x.k): (x.lat, x.lng) for x in decode_chunks(c.where("chunk % 2 = 1")).collect()}   # without their neighbours
    want = {}
    for t in {x[0] for x in rows}:
        for i, x in enumerate(sorted((x for x in rows if x[0] == t), key=lambda x: x[1])):
            if i // 32 % 2:
                want[t, i // 32, i % 32 + 1] = (round(x[3] * 1e5) / 1e5, round(x[2] * 1e5) / 1e5)
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k]))


def test_nearby_with_a_hot_cell_is_spread_and_whole(spark):
    from wayline.operators.nearby import nearby_stats
    pts = spark.range(1200).select(F.col("id").alias("oid"), F.when(F.col("id") % 3 > 0, 116.5 + F.col("id") / 1e7).otherwise(116 + F.col("id") % 97 / 97).alias("lng"),
                                   F.when(F.col("id") % 3 > 0, 39.9).otherwise(39.5 + F.col("id") % 89 / 89).alias("lat"))
    a = sorted(map(tuple, nearby_stats(pts, pts, 500.0, cell_rows=50).collect()))
    b = sorted(map(tuple, nearby_stats(pts, pts, 500.0, cell_rows=1 << 30).collect()))
    assert [(x[0], x[1]) for x in a] == [(x[0], x[1]) for x in b] and max(x[1] for x in a) >= 800
    assert all(abs(x[3] - y[3]) < 1e-6 for x, y in zip(a, b))


def test_json_arrays_in_many_files(spark, tmp_path):
    import json
    import uuid
    from wayline.sources.readers import scan_cases_json, scan_json_arrays
    from wayline.sources.writers import write_json_arrays
    rows = [(i, "text, with ] and [ and \n line" if i % 2 else None, [i, i + 1]) for i in range(40)] * 2
    df = spark.createDataFrame(rows, "a int, b string, c array<int>").repartition(5)
    path = str(tmp_path / uuid.uuid4().hex)
    write_json_arrays(df.union(df.limit(0)), path)
    for got in (scan_json_arrays(spark, path, df.schema), scan_cases_json(spark, path, df.schema)):
        assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    files = [f for f in (tmp_path / path.split("/")[-1]).iterdir() if f.suffix == ".txt"]
    assert len(files) > 1 and sum(len(json.loads(f.read_text())) for f in files) == 80
    (tmp_path / path.split("/")[-1] / "bad.txt").write_text("[not json]")
    import pytest
    with pytest.raises(Exception):
        scan_json_arrays(spark, path, df.schema).collect()


def test_certificate_of_a_solved_program(spark):
    from wayline.operators.linalg import certificate
    a = spark.createDataFrame([(1, 1, 1.0), (2, 2, 2.0), (3, 1, 3.0), (3, 2, 2.0)], "i int, j int, v double")
    rhs = spark.createDataFrame([(1, "<=", 4.0), (2, "<=", 12.0), (3, "<=", 18.0)], "i int, rel string, b double")
    c = spark.createDataFrame([(1, 3.0), (2, 5.0)], "j int, v double")
    x = spark.createDataFrame([(1, 2.0), (2, 6.0)], "j int, v double")
    y = spark.createDataFrame([(2, 1.5), (3, 1.0)], "i int, v double")
    k = certificate(a, rhs, c, x, y).first()
    assert k.optimal and k.primal_objective == k.dual_objective == 36.0 and k.rows_not_complementary == k.columns_not_complementary == 0
    k = certificate(a, rhs, c, x.where("j = 2"), y).first()
    assert not k.optimal and k.gap == 6.0 and k.rows_not_complementary == 1 and k.rows_broken == k.columns_broken == 0


def test_labels_that_do_not_fit_raise(spark):
    import pytest
    from wayline.functions.sequence import one_hot_positions
    df = spark.createDataFrame([([0, 2, 1],)], "y array<int>")
    assert df.select(one_hot_positions("y", 4).alias("m")).first().m[1] == [0, 0, 1, 0]
    with pytest.raises(Exception, match="does not fit"):
        df.select(one_hot_positions("y", 2)).collect()


def test_index_pages_are_bounded(spark):
    from wayline.operators.stats import group_index, index_directory
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).alias("f"), (F.col("id") % 2).alias("g"), (F.col("id") % 50).alias("v"))
    p = group_index(df, "f", "g", "v", page=16).cache()
    assert p.agg(F.max(F.size("values"))).first()[0] == 16
    want = {(r.f, r.g): r.n for r in df.groupBy("f", "g").agg(F.count("*").alias("n")).collect()}
    assert {(r.f, r.g): r.n for r in index_directory(p, "f", "g").collect()} == want
    one = [v for r in p.where("f = 0 and g = 0").orderBy("page").collect() for v in r["values"]]
    assert one == sorted(one)
