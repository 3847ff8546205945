"""Ordered work that stays spread when one key is hot.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.
When one key (a trip, a user, a sequence) may hold a third of all rows, that
task is the whole job.

- ``runs`` range-partitions rows by key and order, so each partition is a run of
  consecutive rows of bounded number, whatever the keys hold.  A window inside
  ``(run, key)`` sees bounded rows; what crosses a run is merged from one summary
  row per run and key (at most the keys plus the partitions).
- ``numbered`` and ``totals_before`` number rows and total values over all runs.
- ``with_previous`` and ``running_sum`` split a key by a bucket column that is
  monotone in the order, and repair the edges from a summary per bucket.
"""

from __future__ import annotations

import uuid
from itertools import accumulate
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.session import scratch_path

RUN = "_run"


def runs(df: DataFrame, key, order) -> DataFrame:
    """``df`` range-partitioned by key and order, with its run (partition) number in ``_run``.

    Rows of one run are consecutive in ``(key, order)``, and run numbers grow with
    it; AQE may merge neighbouring small ones.  The number stands for one evaluation
    of the plan only: use it in the same plan, or write the table.
    """
    return df.repartitionByRange(*_cols(key), *_cols(order)).withColumn(RUN, F.spark_partition_id())


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: evaluated once, whoever reads it."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order, key=(), out: str = "row_no") -> DataFrame:
    """Add ``out``: 1-based position by ``order``, over all rows or within ``key``.

    ``order`` (names or expressions of any orderable type) must be unique within a
    key.  The rows are range-partitioned, sorted and written with their place in
    their run; one count per run (as many as there are partitions) comes back as
    offsets, which are added in the reading pass.  Positions within a key subtract
    the key's first position, one row per key.
    """
    key = _names(key)
    ranged = runs(df, key, order).sortWithinPartitions(*key, *_cols(order))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))   # low bits: place within the partition
    tab = written(ranged.select(*df.columns, RUN, place.alias("_place")), "numbered")
    sizes = {r[RUN]: r["n"] for r in tab.groupBy(RUN).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes, default=0)))]
    at = F.col("_place") + F.get(F.lit(before), F.col(RUN))
    if not key:
        return tab.select(*df.columns, (at + 1).alias(out))
    tab = tab.select(*df.columns, at.alias("_at"))
    first = tab.groupBy(*key).agg(F.min("_at").alias("_first"))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    return tab.alias("t").join(first.alias("f"), same).select(
        *[F.col(f"t.{c}") for c in df.columns], (F.col("t._at") - F.col("f._first") + 1).alias(out))


def totals_before(df: DataFrame, order, value: str, out: str = "_below") -> DataFrame:
    """Run-wise sums: adds ``out``, the sum of ``value`` over the earlier rows of the same run.

    The sum over whole earlier runs is left to the merge of the caller's own
    summaries, one row per run.
    """
    w = Window.partitionBy(RUN).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, -1)
    return runs(df, [], order).select("*", F.coalesce(F.sum(value).over(w), F.lit(0)).alias(out))


def _cols(x) -> list:
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def _names(x) -> list[str]:
    return list(_cols(x))


def with_previous(df: DataFrame, key, order, cols: Sequence[str],
                  bucket: Column | None = None, prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>``: the value of ``c`` on the previous row by ``order`` within ``key``.

    ``order`` must be a unique ordering within a key.  With ``bucket`` (a
    column that is monotone in ``order``, such as ``date_trunc('hour', ts)``)
    the window runs per ``(key, bucket)`` and the first row of a bucket takes
    the last row of the latest earlier bucket of the same key.
    """
    key, order, cols = _names(key), _cols(order), list(cols)
    if bucket is None:
        w = Window.partitionBy(*key).orderBy(*order)
        return df.select("*", *[F.lag(c).over(w).alias(prefix + c) for c in cols])
    b = df.withColumn("_bk", bucket)
    w = Window.partitionBy(*key, "_bk").orderBy(*order)
    b = b.select("*", F.row_number().over(w).alias("_rn"),
                 *[F.lag(c).over(w).alias(prefix + c) for c in cols])
    order_struct = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    last = (b.groupBy(*key, "_bk")
             .agg(F.max_by(F.struct(*cols), order_struct).alias("_last")))
    wl = Window.partitionBy(*key).orderBy("_bk")
    carry = last.select(*key, "_bk", F.lag("_last").over(wl).alias("_carry"))
    j = b.join(carry, key + ["_bk"], "left")
    out = j.select(*[F.col(c) for c in df.columns],
                   *[F.when(F.col("_rn") == 1, F.col("_carry")[c])
                      .otherwise(F.col(prefix + c)).alias(prefix + c) for c in cols])
    return out


def running_sum(df: DataFrame, key, order, cols: Sequence[str],
                bucket: Column | None = None, prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<c>``: inclusive running sum of ``c`` by ``order`` within ``key``.

    ``key`` may be empty (a global running sum); then a ``bucket`` is
    required, otherwise all rows would meet in one task.  Buckets must be
    monotone in ``order``.  Per-bucket totals (one row per key and bucket)
    are prefix-summed and added as offsets.
    """
    key, order, cols = _names(key), _cols(order), list(cols)
    if bucket is None:
        if not key:
            raise ValueError("a global running sum needs a bucket column")
        w = (Window.partitionBy(*key).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.select("*", *[F.sum(c).over(w).alias(prefix + c) for c in cols])
    b = df.withColumn("_bk", bucket)
    w = (Window.partitionBy(*key, "_bk").orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    b = b.select("*", *[F.sum(c).over(w).alias("_in_" + c) for c in cols])
    tot = b.groupBy(*key, "_bk").agg(*[F.sum(c).alias("_t_" + c) for c in cols])
    wl = (Window.partitionBy(*key).orderBy("_bk") if key else Window.orderBy("_bk"))
    wl = wl.rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*key, "_bk", *[F.coalesce(F.sum("_t_" + c).over(wl), F.lit(0))
                                   .alias("_o_" + c) for c in cols])
    j = b.join(off, key + ["_bk"], "left")
    return j.select(*[F.col(c) for c in df.columns],
                    *[(F.col("_in_" + c) + F.col("_o_" + c)).alias(prefix + c) for c in cols])
