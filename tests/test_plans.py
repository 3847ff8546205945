"""Plan assertions: pruning, pushdown, no Python in native operators."""

import uuid

from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partition_filter_reaches_scan(spark, tmp_path):
    from wayline.sources.readers import scan_partition
    from wayline.sources.writers import write_partitions
    path = str(tmp_path / uuid.uuid4().hex)
    df = spark.createDataFrame([(i, f"2024-01-0{i % 3 + 1}") for i in range(30)], "v int, dt string")
    write_partitions(df, path, ["dt"])
    s = scan_partition(spark, None, "2024-01-02", n=None, path=path)
    p = _plan(s)
    assert "PartitionFilters: [isnotnull(dt" in p and "2024-01-02" in p
    assert s.count() == 10


def test_filter_and_projection_pushed(spark, sf):
    from wayline.sources.tables import table
    df = table(spark, sf, "lineitem").where(F.col("l_quantity") > 40).select("l_orderkey")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p


def test_native_operators_have_no_python(spark, sf):
    import __spark_entry__ as E
    qs = E.queries()
    for n in ["trip_summary", "tree_score", "encode_tokens", "competing_risk_nll", "decode_polylines"]:
        p = _plan(qs[n](spark, sf))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, n


def test_tree_scoring_is_a_projection(spark, sf):
    import __spark_entry__ as E
    p = _plan(E.queries()["tree_score"](spark, sf))
    assert "Exchange" not in p and "Join" not in p


def _count(plan, word):
    return sum(line.strip(" :+-*()0123456789").startswith(word) for line in plan.splitlines())


def test_segments_take_one_scan_three_exchanges_and_no_join(spark, sf):
    import __spark_entry__ as E
    for n in ["trip_summary", "path_length", "trajectory_stats"]:
        p = _plan(E.queries()[n](spark, sf))
        assert _count(p, "FileScan") == 1 and _count(p, "Exchange") <= 3 and "Join" not in p, (n, p)


def test_vocabulary_work_is_numbered_once(spark, sf, monkeypatch):
    import __spark_entry__ as E
    from wayline.operators import ordered
    built = []
    monkeypatch.setattr(ordered, "written", lambda df, name, f=ordered.written: built.append(_plan(df)) or f(df, name))
    E.queries()["build_vocab"](spark, sf)
    assert len(built) == 1 and _count(built[0], "FileScan") == 1 and "SinglePartition" not in built[0]
    p = _plan(E.queries()["encode_tokens"](spark, sf))
    assert _count(p, "FileScan parquet [l_") == 1 and _count(p, "Exchange") <= 6 and "SinglePartition" not in p, p
    for n in ["batch_rows", "flatten_matrix"]:
        assert "SinglePartition" not in _plan(E.queries()[n](spark, sf)), n
