"""Block matrix neighbours against plain Python: groups, copies, repeated rows, overflow, odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>, rank int, score string, g int"


def _frame(spark, rows, parts=5):
    floats = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 2) for i, v in rows]
    return spark.createDataFrame(floats, SCHEMA).repartition(parts)


def _distance(a, b):
    return math.dist(a, b)


def brute_force(rows, k=10):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    queries = {}
    for i, v in good:
        if i % 100 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, y in queries.items():
        near = sorted((_distance(v, y), i) for i, v in good if i != q and len(v) == len(y))[:k]
        out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def _check(spark, rows, **kw):
    got = sorted(tuple(r) for r in neighbours.nearest(_frame(spark, rows), F.col("vec_id") % 100 == 0, **kw).collect())
    want = brute_force(rows, **kw)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(math.isclose(g[3], w[3], rel_tol=1e-12, abs_tol=0) for g, w in zip(got, want))


@pytest.mark.parametrize("small", [7, 2048])
def test_groups_blocks_and_handing_on_change_nothing(spark, monkeypatch, small):
    r = np.random.default_rng(2)
    rows = [(i * 10, r.integers(-4, 5, 6).astype(float).tolist()) for i in range(300)]  # many ties
    rows += [(100000 + i, [1.0, 2, 3, 4, 5, 6]) for i in range(60)]  # copies
    rows += [(200000 + i, r.normal(size=3).tolist()) for i in range(130)]  # another length
    if small == 7:
        for name, value in (("TILE", 5), ("BLOCK", 3), ("SMALL_GROUP", 7), ("LARGE_GROUP", 50), ("HELD", 4)):
            monkeypatch.setattr(neighbours, name, value)
    _check(spark, rows)


def test_squares_that_overflow(spark):
    r = np.random.default_rng(3)
    rows = [(i * 50, (r.normal(size=4) * 1e200).tolist()) for i in range(40)] + [(i * 100 + 1, r.normal(size=4).tolist()) for i in range(5)]
    rows += [(i * 100 + 7, (r.normal(size=4) * 1e-170).tolist()) for i in range(3)]
    _check(spark, [x for x in rows if x[0] % 100 != 7])
    got = neighbours.nearest(_frame(spark, rows), F.col("vec_id") % 100 == 0)
    assert got.count() == 20 * 10


def test_odd_vectors_repeated_rows_and_empty_table(spark):
    rows = [(0, [1.0, 2]), (0, [1.0, 2]), (0, [0.5, 9]), (1, [1.0, 2]), (1, [1.0, 2]), (2, None), (3, []), (4, [0.0, 0]), (5, [1.0, None]),
            (6, [math.inf, 1]), (7, [math.nan, 1]), (None, [1.0, 2]), (100, [3.0, 3]), (300, [5e-324, 0.0]), (8, [1.0])]
    _check(spark, rows)
    assert neighbours.nearest(_frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_full_heaps_ask_only_for_pairs_that_may_enter(monkeypatch):
    """Tiles that come later: no bounds for every pair, and the same neighbours at any size of the numbers."""
    r = np.random.default_rng(5)
    x = r.integers(-3, 4, (400, 7)).astype(float)  # many ties
    x[200:] += r.normal(size=(200, 7)) * 1e-7
    x[::9] = x[0]
    for size in (1.0, 3e-9, 7e8, 1e-150, 1e200):
        x_ = x * size
        x_[~x_.any(axis=1)] = size
        ids = r.permutation(400)
        first, calls = neighbours._first, []
        monkeypatch.setattr(neighbours, "_first", lambda *a: calls.append(len(a[1])) or first(*a))
        best = {}
        block = neighbours.Tile(ids[:90], x_[:90])
        for at in range(0, 400, 40):
            neighbours._join_tile(best, neighbours.Tile(ids[at:at + 40], x_[at:at + 40]), block, 10)
        monkeypatch.undo()
        assert calls == ([90] if 1e-10 < size < 1e10 else [90] * 10)
        for q, y in zip(ids[:90].tolist(), x_[:90]):
            want = sorted((d, i) for d, i in zip(neighbours.distances(x_, y).tolist(), ids.tolist()) if i != q)[:10]
            assert sorted((-d, -v) for d, v in best[q]) == want


def test_a_block_of_queries_meets_all_tiles_of_a_group(spark, capsys):
    """Tiles and blocks are streamed one after the other; joined row by row, the heaps of many blocks were given up between tiles."""
    neighbours.nearest(_frame(spark, [(i * 50, [float(i), 1.0]) for i in range(40)]), F.col("vec_id") % 100 == 0).explain()
    assert "Join" not in capsys.readouterr().out
