"""Results do not depend on the session time zone (wall-clock timestamps)."""

import pytest


@pytest.mark.parametrize("name", ["case_summary", "shifted_window_features", "rolling_features",
                                  "trajectory_stats", "array_trajectory"])
def test_same_result_in_other_zone(spark, sf, name):
    import __spark_entry__ as E
    q = E.queries()[name]
    base = q(spark, sf).collect()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        other = q(spark, sf).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(base, key=key) == sorted(other, key=key)
