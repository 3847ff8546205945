"""Line numbers over several files, JSON arrays with equal records, list codes with unknown buckets."""

import json

import pytest

from wayline.operators import vocab as vc
from wayline.sources import readers as rd
from wayline.sources import writers as wr


def test_line_numbers_follow_file_order(spark, tmp_path):
    (tmp_path / "part-0").write_text("1.0,2.0\n\n")
    (tmp_path / "part-1").write_text("".join(f"{i}.0,2.0,t{i}\n" for i in range(37)))
    r = sorted(rd.scan_points_csv(spark, str(tmp_path)).collect())
    assert [x.ordinal for x in r] == list(range(39))
    assert (r[0].lng, r[0].title, r[1].lng, r[1].title) == (1.0, "0", None, "1")
    assert [x.title for x in r[2:]] == [f"t{i}" for i in range(37)]


@pytest.mark.parametrize("values", [[], [1], [1, 1, 2, 2, 0, 0]])
def test_json_array_with_equal_records(spark, tmp_path, values):
    path = str(tmp_path / "a")
    wr.write_json_arrays(spark.createDataFrame([(v,) for v in values], "a int"), path)
    records = [x["a"] for f in (tmp_path / "a").glob("part-*") for x in json.loads(f.read_text())]
    assert sorted(records) == sorted(values)


def test_list_codes(spark):
    vocab = vc.list_vocab(spark, ["x", "y"], "f")
    df = spark.createDataFrame([(1, ["y", "q", None, "x"]), (2, []), (3, None)], "k int, a array<string>")
    got = {r.k: r.ids for r in vc.encode_oov_lists(df, vocab, "a", "f", 1, "k", out="ids").collect()}
    assert got == {1: [1, 2, 2, 0], 2: [], 3: None}
    with pytest.raises(TypeError):
        vc.encode_oov_buckets(df, vocab, "a", "f", 1)


def test_required_column_fails(spark, tmp_path):
    from pyspark.sql import types as T
    path = str(tmp_path / "p")
    spark.createDataFrame([(None,)], "a int").write.parquet(path)
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    for need in (rd.Required, rd.Required()):
        with pytest.raises(Exception, match="required column a"):
            rd.scan_with_defaults(spark, path, schema, {"a": need}).collect()


def test_neighbours_over_the_180th_meridian(spark):
    from wayline.operators.nearby import nearby_stats
    left = spark.createDataFrame([("a", 179.999, 0.0), ("b", -179.9995, 0.0), ("c", 0.0, 0.0)], "oid string, lng double, lat double")
    right = spark.createDataFrame([(-179.999, 0.0), (179.9995, 0.0)], "lng double, lat double")
    got = {r.oid: r.n_cars for r in nearby_stats(left, right, 500.0).collect()}
    assert got == {"a": 2, "b": 2, "c": 0}


def test_nearby_stats_repeated_places_and_keys(spark):
    """Equal places count as often as they occur, a key's rows add up, and rows without key or place have none."""
    import math
    import random

    from wayline.functions.geo import EARTH_RADIUS_M
    from wayline.operators.nearby import nearby_stats

    r = random.Random(5)
    spots = [(116 + r.random() / 10, 39.6 + r.random() / 10) for _ in range(40)]
    left = [(i % 70, *r.choice(spots)) for i in range(90)] + [(200, None, 39.6), (None, *spots[0]), (201, 10.0, 10.0)]
    right = [r.choice(spots) if i % 2 else (116 + r.random() / 10, 39.6 + r.random() / 10) for i in range(1500)] + [(None, 1.0)]

    def dist(a, b, c, d):
        h = math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2
        return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(h))

    want = {}
    for k, x, y in left:
        if k is not None:
            want.setdefault(k, []).extend(d for u, v in right if x is not None and u is not None for d in [dist(x, y, u, v)] if d <= 3000)
    lf, rt = spark.createDataFrame(left, "oid long, lng double, lat double"), spark.createDataFrame(right, "lng double, lat double")
    for rows in (4096, 3):   # cells whole, and dealt into parts
        got = nearby_stats(lf, rt, 3000.0, cell_rows=rows).collect()
        assert len(got) == len(left)
        for g in got:
            d = want.get(g.oid, [])
            assert g.n_cars == len(d)
            if d:
                assert abs(g.min_dist - min(d)) < 1e-6 and abs(g.avg_dist - sum(d) / len(d)) < 1e-6
            else:
                assert (g.min_dist, g.avg_dist) == (None, None)


def test_nearby_stats_makes_no_row_of_a_pair(spark):
    from wayline.operators.nearby import nearby_stats

    p = spark.range(400).selectExpr("id as oid", "116 + id / 1e6 as lng", "39.6 + id / 1e6 as lat")
    plan = nearby_stats(p, p, 3000.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "_cx" not in "".join(x for x in plan.splitlines() if "Join Inner" in x)


def test_one_hot_positions_odd_labels(spark):
    from wayline.functions import sequence as sq

    df = spark.createDataFrame([(1, [2, 0, 1]), (2, [None, 3, -1]), (3, []), (4, None), (5, [0, 1, 2, 3, 0])], "k int, y array<int>")
    plan = df.select(sq.one_hot_positions("y", 4).alias("m"))
    got = {r.k: r.m for r in df.select("k", sq.one_hot_positions("y", 4).alias("m")).collect()}
    zero = [0] * 4
    one = lambda j: [int(i == j) for i in range(4)]
    assert got == {1: [one(2), one(0), one(1), zero], 2: [zero, one(3), zero, zero], 3: [zero] * 4, 4: [zero] * 4,
                   5: [one(1), one(2), one(3), one(0)]}
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("sequence(") == 0   # no loop over the T x T cells


def test_pad_matrix_query_adds_only_what_is_not_zero(spark, sf):
    from wayline.plans import q_vocab

    plan = q_vocab.q_pad_matrix(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_remove(flatten(" in plan


def test_json_arrays_are_written_in_small_batches(spark, tmp_path, monkeypatch):
    """Long records come to the writing task's Python a few at a time, and the files hold them all."""
    import json

    from wayline.sources import writers as wr

    monkeypatch.setattr(wr, "ARRAY_BATCH_BYTES", 1 << 16)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    df = spark.range(300, numPartitions=3).selectExpr("id", "repeat('x', 5000) as t")
    seen = []
    wr.write_json_arrays(df, str(tmp_path / "a"))
    assert spark.conf.get(key) == before
    for f in (tmp_path / "a").glob("part-*"):
        seen += [x["id"] for x in json.loads(f.read_text())]
    assert sorted(seen) == list(range(300))
    spark.conf.set(key, str(1 << 16))
    try:
        sizes = df.mapInArrow(lambda bs: (b.__class__.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
    finally:
        spark.conf.set(key, before)
    assert max(r.n for r in sizes) < 40


def test_feature_frame_encodes_each_list_once(spark, sf):
    from wayline.plans import q_features

    plan = q_features.feature_frame(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [oid" in x for x in plan.splitlines())   # orders are never grouped again by their id
