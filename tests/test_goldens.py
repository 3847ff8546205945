"""Golden cases and properties from the reference's own checks."""

import math

import pytest
from pyspark.sql import functions as F


def test_kl_golden(spark):
    from wayline.operators.stats import kl_divergence
    rows = [(0, "a")] * 7 + [(0, "b")] + [(0, "c")] * 2 + [(1, "a")] * 2 + [(1, "b")] + [(1, "c")] * 7
    df = spark.createDataFrame(rows, "side int, key string")
    r = kl_divergence(df).first()
    assert r["kl_pq"] == pytest.approx(0.5 * math.log(3.5), abs=1e-9)
    assert r["kl_qp"] == pytest.approx(0.5 * math.log(3.5), abs=1e-9)


def test_kl_missing_category_is_infinite(spark):
    from wayline.operators.stats import kl_divergence
    df = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a")], "side int, key string")
    r = kl_divergence(df).first()
    assert math.isinf(r["kl_pq"]) and r["kl_qp"] >= 0


def test_assignment_golden(spark):
    """Assignment (0,2),(1,0),(2,1) of the 3 x 3 problem: all six equalities hold, objective 6."""
    from wayline.operators.linalg import bounds_check, check_constraints, objective
    # Matrix and costs of the problem
    A = [[1, 1, 1, 0, 0, 0, 0, 0, 0], [0, 0, 0, 1, 1, 1, 0, 0, 0], [0, 0, 0, 0, 0, 0, 1, 1, 1],
         [1, 0, 0, 1, 0, 0, 1, 0, 0], [0, 1, 0, 0, 1, 0, 0, 1, 0], [0, 0, 1, 0, 0, 1, 0, 0, 1]]
    INF = 1e32
    c = [4, -INF, 3, 2, -INF, -INF, -INF, 1, 5]
    x = [0.0] * 9
    for i, j in [(0, 2), (1, 0), (2, 1)]:
        x[3 * i + j] = 1.0
    a = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(A) for j, v in enumerate(r) if v],
                              "i int, j int, v double")
    xv = spark.createDataFrame([(j, v) for j, v in enumerate(x)], "j int, v double")
    rhs = spark.createDataFrame([(i, "==", 1.0) for i in range(6)], "i int, rel string, b double")
    res = check_constraints(a, xv, rhs).collect()
    assert len(res) == 6 and all(r["holds"] for r in res)
    cv = spark.createDataFrame([(j, float(v)) for j, v in enumerate(c)], "j int, v double")
    assert objective(cv, xv).first()["objective"] == pytest.approx(6.0)
    assert bounds_check(xv, 0.0, 1.0).first()["in_bounds"]


def test_pair_counts(spark):
    from wayline.operators.linalg import pair_counts
    r = pair_counts(spark.range(10)).first()
    assert (r["n"], r["cross_pairs"], r["triangle_pairs"]) == (10, 100, 55)


# Texts of the three trips below in the path format
PATH_TEXTS = {
    1: "wii3rsoj6NMHMHMHMHMHM",
    2: "3om6nn7pvH2k9zHwoju0qL",
    3: "DT",
}


def test_polyline_codec_round_trip(spark):
    import datetime
    from wayline.operators.polyline import decode_polylines, encode_polylines
    t0 = datetime.datetime(2024, 1, 1)
    trips = {
        1: [(116.0 + 0.00001 * i, 39.9 + 0.00001 * (i % 2)) for i in range(12)],   # single-digit steps
        2: [(-73.98765, 40.71234), (-73.98765, 40.71234), (-73.98, 40.7), (-73.98, 40.7), (-73.5, 41.0)],
        3: [(0.00001, 0.0), (0.0, 0.00002)],
    }
    rows = [(k, i, t0 + datetime.timedelta(minutes=37 * i), p[0], p[1])
            for k, pts in trips.items() for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "trip long, seq long, ts timestamp, lng double, lat double")
    enc = {r["trip"]: r["text"] for r in encode_polylines(df).collect()}
    for k, pts in trips.items():
        assert enc[k] == PATH_TEXTS[k]
    dec = decode_polylines(encode_polylines(df)).orderBy("trip", "k").collect()
    for k, pts in trips.items():
        want = []
        for p in pts:
            q = (round(p[0] * 1e5), round(p[1] * 1e5))
            if not want or want[-1] != q:
                want.append(q)
        got = [(round(r["lng"] * 1e5), round(r["lat"] * 1e5)) for r in dec if r["trip"] == k]
        assert got == want


def test_softmax_sums_to_one(spark, sf):
    from wayline.operators.scoring import masked_softmax
    from wayline.plans.q_scoring import step_scores
    s = masked_softmax(step_scores(spark, sf)).groupBy("seq_id", "step").agg(F.sum("prob").alias("p"))
    assert s.where(F.abs(F.col("p") - 1) > 1e-9).count() == 0


def test_all_masked_step_has_no_nan(spark):
    from wayline.operators.scoring import masked_softmax
    df = spark.createDataFrame([(1, 0, 1, 0.5, False), (1, 0, 2, 1.5, False)],
                               "seq_id int, step int, cand int, logit double, valid boolean")
    p = [r["prob"] for r in masked_softmax(df).collect()]
    assert all(not math.isnan(x) for x in p) and sum(p) == pytest.approx(1.0)


def test_vocab_ids_dense_from_one(spark, sf):
    from wayline.plans.q_vocab import train_vocab
    v = train_vocab(spark, sf)
    g = v.groupBy("field").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"),
                               F.countDistinct("id").alias("d")).collect()
    for r in g:
        assert r["lo"] == 1 and r["hi"] == r["n"] == r["d"]
    assert v.where(F.col("token") == "Non").count() == 6


def test_split_parts_disjoint_and_complete(spark, sf):
    from wayline import fixtures as fx
    from wayline.operators.vocab import split_by_coverage
    from wayline.plans.q_vocab import MISS_FIELDS, TEST, train_vocab
    test = fx.sequences(spark, sf, TEST)
    s = split_by_coverage(test, train_vocab(spark, sf), MISS_FIELDS, "seq_id")
    assert s.count() == test.count()
    assert s.select("seq_id").distinct().count() == test.count()
    assert set(r[0] for r in s.select("part").distinct().collect()) <= {0, 1}


def test_tree_attribution_total(spark, sf):
    """Total attribution = sum over trees of (leaf / shrinkage - root value)."""
    from wayline.operators import trees as tr
    from wayline.plans.models import tree_nodes
    from wayline.plans.q_scoring import FEATURES, tree_input
    model = tr.read_model(tree_nodes(spark))
    df = tree_input(spark, sf)
    a = tr.tree_attribution(tr.tree_score(df, model, FEATURES, 3), model, FEATURES)
    roots = {0: 0.0, 1: 0.05, 2: -0.1}
    expect = sum(F.col(f"score_{k}") / F.lit(0.1) - F.lit(roots[k]) for k in range(3))
    bad = a.where(F.abs(F.col("contrib_total") - expect) > 1e-9).count()
    assert bad == 0


def test_tree_missing_and_equality(spark):
    from wayline.operators import trees as tr
    from wayline.plans.models import tree_nodes
    model = tr.read_model(tree_nodes(spark))
    rows = [(10.0, 0.01, -1.0, -1.0), (30.0, 0.09, 0.05, 3.0), (30.0, 0.09, 0.05, 2.9)]
    df = spark.createDataFrame(rows, "f0 double, f1 double, f2 double, f3 double")
    s = [r["score_0"] for r in tr.tree_score(df, model, ["f0", "f1", "f2", "f3"], 1).collect()]
    # row 1: t0 left/left -0.05; t1 missing -> left 0.015; t2 missing -> left -0.03
    assert s[0] == pytest.approx(-0.05 + 0.015 - 0.03)
    # row 2: t0 right, int(3) in 1||3||5 -> 0.04; t1 right, f0<=40 -> -0.005; t2 3 not in 2||4 -> f1>0.08 -> 0.06
    assert s[1] == pytest.approx(0.04 - 0.005 + 0.06)
    # row 3: int(2.9) = 2: t0 -> 0.02; t2 2 in 2||4 -> -0.03
    assert s[2] == pytest.approx(0.02 - 0.005 - 0.03)


def test_default_for_zero_bounds(spark):
    from wayline.functions.scalars import default_for_zero
    df = spark.createDataFrame([(-1e-20,), (1e-20,), (0.0,), (2e-20,)], "v double")
    got = [r[0] for r in df.select(default_for_zero("v", 9.0)).collect()]
    assert got == [-1e-20, 9.0, 9.0, 2e-20]


def test_sequence_padding(spark):
    from wayline.functions import sequence as sq
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6, 7],), ([3],)], "a array<int>")
    r = df.select(sq.pad_sequence("a", 5).alias("p"), sq.one_hot_positions("a", 8).alias("o")).collect()
    assert r[0]["p"] == [3, 4, 5, 6, 7] and r[1]["p"] == [3, 0, 0, 0, 0]
    assert r[1]["o"][0] == [0, 0, 0, 1, 0, 0, 0, 0] and all(sum(x) == 0 for x in r[1]["o"][1:])
    with pytest.raises(Exception, match="does not fit"):   # 5, 6 and 7 are kept, and are no places of 0 to 4
        df.select(sq.one_hot_positions("a", 5)).collect()
    m = spark.createDataFrame([([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]],)], "m array<array<double>>")
    out = m.select(sq.pad_matrix("m", 3).alias("x")).first()["x"]
    assert len(out) == 3 and all(len(r) == 4 for r in out) and out[2] == [0.0] * 4
    with pytest.raises(Exception):
        m.select(sq.pad_matrix("m", 1)).collect()


def test_sql_batch_zip_rules(spark):
    from wayline.plans.sql import sql_batch, zip_batch
    assert zip_batch({"a": [1, 2, 3], "b": ["x", "y"]}, {"b": "z"}) == [{"a": 1, "b": "z"}, {"a": 2, "b": "z"}]
    with pytest.raises(ValueError):
        zip_batch({})
    df = sql_batch(spark, "SELECT {a} AS a, {b} AS b", {"a": [1, 2, 2]}, {"b": "k"})
    assert [tuple(r) for r in df.collect()] == [(1, "k"), (2, "k"), (2, "k")]


def test_proj_hex_sql_matches_column(spark):
    from wayline.functions.geo import proj_hex
    from wayline.plans.sql import register_sql_functions
    register_sql_functions(spark, ["proj_hex"])
    df = spark.createDataFrame([(116.3 + i * 0.013, 39.9 + i * 0.007) for i in range(50)], "lng double, lat double")
    df.createOrReplaceTempView("hx")
    a = [r[0] for r in spark.sql("SELECT proj_hex(lng, lat, 500D) FROM hx").collect()]
    b = [r[0] for r in df.select(proj_hex("lng", "lat", 500)).collect()]
    assert a == b


def test_guard_raises(spark):
    from wayline.operators.shape import guard
    df = spark.createDataFrame([(1,), (-1,)], "v int")
    with pytest.raises(Exception):
        guard(df, F.col("v") > 0, "negative").collect()


def test_json_lines_failfast(spark, tmp_path):
    from pyspark.sql import types as T
    from wayline.sources.readers import scan_json_lines
    p = tmp_path / "bad.json"
    p.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        scan_json_lines(spark, str(p), T.StructType([T.StructField("a", T.LongType())])).collect()


def test_svmlight_zero_based(spark, tmp_path):
    from wayline.sources.readers import scan_svmlight
    p = tmp_path / "x.svm"
    p.write_text("1 0:5.7 1:2.8 2:4.1 3:1.3\n0 2:1.0\n")
    r = scan_svmlight(spark, str(p)).collect()
    assert r[0]["label"] == 1.0 and r[0]["features"][0] == 5.7 and r[1]["features"] == {2: 1.0}
