"""As-of join: each left row takes the latest right values of its key at its time."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.ordered import RUN, runs, written


def as_of(left: DataFrame, right: DataFrame, key, at: str, right_at: str, values: Sequence[str],
          strict: bool = False) -> DataFrame:
    """``left`` with, for each of ``values``, its last non-null value among the right rows
    of the same key at or before (``strict``: before) the row's time.

    Both sides are united and range-partitioned by (key, time), so a hot key is cut
    into runs; the last value is carried down inside each run, and across runs from
    one row per run and key.  Only a key that goes on from the run before needs that,
    at most one in each run, so the carried table is broadcast.  A null key or time
    finds nothing.
    """
    key = [key] if isinstance(key, str) else list(key)
    side_l, side_r = (0, 1) if strict else (1, 0)
    whole = F.struct(*left.columns)
    names = [f"_v{i}" for i in range(len(values))]
    lt = left.select(whole.alias("s")).schema["s"].dataType
    l_ = left.select(*key, F.col(at).alias("_at"), F.lit(side_l).alias("_side"), whole.alias("_left"),
                     *[F.lit(None).cast(right.schema[v].dataType).alias(n) for v, n in zip(values, names)])
    known = F.col(right_at).isNotNull()
    for k in key:
        known = known & F.col(k).isNotNull()
    r_ = right.where(known).select(*key, F.col(right_at).alias("_at"), F.lit(side_r).alias("_side"), F.lit(None).cast(lt).alias("_left"),
                                   *[F.col(v).alias(n) for v, n in zip(values, names)])
    w = Window.partitionBy(RUN, *key).orderBy("_at", "_side")
    down = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = runs(l_.unionByName(r_), key, ["_at", "_side"]).select(
        RUN, *key, "_left", F.lead(F.lit(True)).over(w).isNull().alias("_end"),
        *[F.last(n, ignorenulls=True).over(down).alias(n) for n in names])
    tab = written(x.where(F.col("_left").isNotNull() | F.col("_end")), "as-of")
    ends = Window.partitionBy(*key).orderBy(RUN)
    earlier = ends.rowsBetween(Window.unboundedPreceding, -1)
    carry = tab.where("_end").select(F.col(RUN).alias("_crun"), *[F.col(k).alias(f"_c{i}") for i, k in enumerate(key)],
                                     F.lag(RUN).over(ends).alias("_before"),
                                     *[F.last(n, ignorenulls=True).over(earlier).alias(f"{n}c") for n in names])
    same = F.col(RUN) == F.col("_crun")
    for i, k in enumerate(key):
        same = same & (F.col(k) == F.col(f"_c{i}"))
    out = tab.where(F.col("_left").isNotNull()).join(F.broadcast(carry.where(F.col("_before").isNotNull())), same, "left")
    found = F.lit(True)
    for k in key:
        found = found & F.col(f"_left.{k}").isNotNull()
    return out.select(*[F.col("_left")[c].alias(c) for c in left.columns],
                      *[F.when(found, F.coalesce(n, f"{n}c")).alias(v) for v, n in zip(values, names)])
