"""Trees of realistic size: 200 trees, 50 features, depth 6, checked against a plain walk."""

import random

import pytest

from wayline.operators import trees as tr
from wayline.plans.models import NODE_SCHEMA

FEATURES = [f"f{i}" for i in range(50)]


def big_model(n_trees=200, depth=6):
    rnd, rows = random.Random(5), []
    inner = 2 ** depth - 1
    for t in range(n_trees):
        for i in range(2 ** (depth + 1) - 1):
            if i < inner:
                kind = "==" if i % 7 == 3 else "<="
                threshold = "1||3||4" if kind == "==" else str(rnd.uniform(0, 5))
                rows.append((t, i, rnd.randrange(50), kind, threshold, rnd.random() < 0.5, 2 * i + 1, 2 * i + 2, rnd.random(), None, None, 0.1))
            else:
                rows.append((t, i, None, None, None, None, None, None, None, i - inner, rnd.random(), 0.1))
    return rows


def plain_walk(nodes, row):
    path, i = [], 0
    while nodes[i][2] is not None:
        _, _, f, kind, threshold, default, a, b, *_ = nodes[i]
        v = row[f]
        if v is None:
            left = False
        elif v < 0:
            left = default
        else:
            left = str(int(v)) in threshold.split("||") if kind == "==" else v <= float(threshold)
        path.append(i)
        i = a if left else b
    return path, i


def test_big_model(spark):
    rows = big_model()
    model = tr.read_model(spark.createDataFrame(rows, NODE_SCHEMA))
    rnd = random.Random(6)
    data = [[rnd.choice([-1.0, None, rnd.uniform(0, 5), 3.0]) for _ in FEATURES] for _ in range(40)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "id int, " + ", ".join(f"{f} double" for f in FEATURES))
    scores = {r.id: (r.score_0, r.score_1) for r in tr.tree_score(df, model, FEATURES, 2).collect()}
    parts = {r.id: r for r in tr.tree_attribution(df, model, FEATURES).collect()}
    by_tree = {}
    for r in rows:
        by_tree.setdefault(r[0], {})[r[1]] = r
    for i, x in enumerate(data):
        want, score = [0.0] * 50, [0.0, 0.0]
        for t, nodes in by_tree.items():
            path, leaf = plain_walk(nodes, x)
            score[t % 2] += nodes[leaf][10]
            for a, b in zip(path, path[1:] + [leaf]):
                end = nodes[b][8] if nodes[b][2] is not None else nodes[b][10] / 0.1
                want[nodes[a][2]] += end - nodes[a][8]
        assert scores[i] == pytest.approx(score)
        assert [parts[i]["contrib_" + f] for f in FEATURES] == pytest.approx(want)
        assert parts[i].contrib_total == pytest.approx(sum(want))


def test_odd_models(spark):
    leaf = spark.createDataFrame([(0, 0, None, None, None, None, None, None, None, 0, 0.5, 0.1)], NODE_SCHEMA)
    df = spark.createDataFrame([(1.0,), (None,)], "f0 double")
    assert [r.score_0 for r in tr.tree_score(df, tr.read_model(leaf), ["f0"]).collect()] == [0.5, 0.5]
    assert [r.contrib_total for r in tr.tree_attribution(df, tr.read_model(leaf), ["f0"]).collect()] == [0.0, 0.0]
    two = spark.createDataFrame([(0, i, None, None, None, None, None, None, None, i, 0.5, 0.1) for i in (0, 1)], NODE_SCHEMA)
    with pytest.raises(ValueError, match="one root"):
        tr.read_model(two)
    assert tr.tree_attribution(df.limit(0), tr.read_model(leaf), ["f0"]).count() == 0
