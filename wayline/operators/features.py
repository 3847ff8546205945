"""Feature frames: indicators, assembly, rolling and shifted windows, user history."""

from __future__ import annotations

from typing import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.functions.scalars import epoch_micros, from_epoch_micros, null_indicator
from wayline.operators.asof import as_of


#: The online averages of a start hex (the last one of an end hex), each over four horizons in minutes.
ONLINE_METRICS = ["avgCancelNumber", "avgScheduleNumber", "avgScheduleTime", "avgSubmitNumber", "avgSubmitNumberEnd"]
ONLINE_HORIZONS = (5, 10, 15, 30)
ONLINE_COLUMNS = [f"online_{m}{h}min" for m in ONLINE_METRICS for h in ONLINE_HORIZONS]


def null_indicators(df: DataFrame, cols: Sequence[str], fill=0.0) -> DataFrame:
    """Add ``null_<c>`` (1 where ``c`` is null) and fill ``c`` with ``fill``."""
    out = []
    for c in df.columns:
        if c in cols:
            out += [F.coalesce(F.col(c), F.lit(fill)).alias(c), null_indicator(c).alias("null_" + c)]
        else:
            out.append(F.col(c))
    return df.select(*out)


def indicator_defaults(df: DataFrame, user_cols: Sequence[str], other_cols: Sequence[str]) -> DataFrame:
    """Absent indicator values: 1 for user columns, 0 for the others."""
    sel = []
    for c in df.columns:
        if c in user_cols:
            sel.append(F.coalesce(F.col(c), F.lit(1).cast("bigint")).alias(c))
        elif c in other_cols:
            sel.append(F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c))
        else:
            sel.append(F.col(c))
    return df.select(*sel)


def assemble_features(df: DataFrame, groups: Mapping[str, Sequence[str]],
                      order: Sequence[str] = ("embedding", "order", "spacetime"), out: str = "features") -> DataFrame:
    """Concatenate feature groups in ``order`` (scalars and arrays) into one
    ``array<double>``; groups not named in ``order`` (the user group) are left out."""
    parts = []
    for g in order:
        for c in groups.get(g, []):
            t = df.schema[c].dataType.typeName()
            parts.append(F.transform(F.col(c), lambda x: x.cast("double")) if t == "array"
                         else F.array(F.col(c).cast("double")))
    return df.withColumn(out, F.concat(*parts))


def window_averages(events: DataFrame, key: str, ts: str, metrics: Mapping[str, Column],
                    horizons: Sequence[int] = ONLINE_HORIZONS) -> DataFrame:
    """Averages of ``metrics`` over windows of each horizon: (key, window end, one struct per horizon).

    A row holds the struct of its own horizon; the others are null, so several
    horizons share one time line.
    """
    minute = 60 * 1_000_000
    t = epoch_micros(ts)
    end = [F.struct(F.lit(h).alias("h"), ((F.floor(t / F.lit(h * minute)) + 1) * F.lit(h * minute)).cast("bigint").alias("end"))
           for h in horizons]
    x = events.where(F.col(ts).isNotNull()).select(key, F.explode(F.array(*end)).alias("_w"), *[c.cast("double").alias(m) for m, c in metrics.items()])
    g = x.groupBy(key, "_w").agg(*[F.avg(m).alias(m) for m in metrics])
    return g.select(key, F.col("_w.end").alias("window_end"),
                    *[F.when(F.col("_w.h") == h, F.struct(*metrics)).alias(f"h{h}") for h in horizons])


def online_features(orders: DataFrame, windows: DataFrame, key: str, at: str, metrics: Sequence[str],
                    horizons: Sequence[int] = ONLINE_HORIZONS) -> DataFrame:
    """Each order with the averages of the latest window of its key that ended at or before ``at``
    (epoch microseconds), for each horizon: ``online_<metric><h>min``."""
    got = as_of(orders, windows, key, at, "window_end", [f"h{h}" for h in horizons])
    return got.select(*orders.columns, *[F.col(f"h{h}")[m].alias(f"online_{m}{h}min") for m in metrics for h in horizons])


def time_slice(ts, minutes: int) -> "F.Column":
    """Slot of the day: ``floor(minute_of_day / minutes)`` as text."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.floor((F.hour(t) * 60 + F.minute(t)) / F.lit(minutes)).cast("bigint").cast("string")


def weekday_text(ts) -> "F.Column":
    """Weekday as text, Monday = '1' ... Sunday = '7'."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return (F.weekday(t) + 1).cast("string")


def rolling_features(df: DataFrame, key: str, ts: str, metrics: Mapping[str, str],
                     horizons: Sequence[int] = (5, 10, 15, 30), name: str = "online_{m}{h}min",
                     bucket_minutes: int = 1440) -> DataFrame:
    """Per row, aggregates of the same key over the last ``h`` minutes (both ends
    included, rows of the same time too), for each horizon.

    ``metrics`` maps a metric name to ``avg:<col>``, ``sum:<col>`` or ``count``.
    A key is split into time buckets; each bucket also gets a copy of the rows of
    the ``max(h)`` minutes before it (a halo) and keeps only its own rows.  Inside a
    bucket the sums run once over the ordered rows; a window is the running sum at
    its end less the running sum as of its start, so the work grows with the rows,
    not with the rows of a window.  Nulls are left out; sums and averages are
    doubles, null over no value.  A task holds one bucket of one key: choose
    ``bucket_minutes`` by the densest key (the halo adds at most
    ``max(h) / bucket_minutes`` copies).  Rows with a null time have null values
    (and count 0).
    """
    micros = 60 * 1_000_000
    t = epoch_micros(ts)
    own = F.floor(t / F.lit(bucket_minutes * micros)).cast("bigint")
    nxt = F.floor((t + F.lit(max(horizons) * micros)) / F.lit(bucket_minutes * micros)).cast("bigint")
    # a halo wider than a bucket reaches all buckets it overlaps
    x = df.select("*", t.alias("_t"), own.alias("_own"),
                  F.explode(F.coalesce(F.sequence(own, nxt), F.array(F.lit(None).cast("bigint")))).alias("_bk"))
    fields = [T.StructField(name.format(m=m, h=h), T.LongType() if spec == "count" else T.DoubleType())
              for h in horizons for m, spec in metrics.items()]
    schema = T.StructType([*df.schema.fields, *fields])
    kept = df.columns

    def run(part: pa.Table) -> pa.Table:
        own_ = part.column("_own").to_numpy(), part.column("_bk").to_numpy()
        if part.column("_t").null_count:   # the bucket of rows without a time
            n = part.num_rows
            cols = [pa.array(np.zeros(n, dtype=np.int64)) if f.dataType == T.LongType() else pa.nulls(n, pa.float64()) for f in fields]
            return pa.table([*[part.column(c) for c in kept], *cols], names=schema.fieldNames())
        time = part.column("_t").to_numpy()
        order = np.argsort(time, kind="stable")
        time = time[order]
        mine = np.flatnonzero((own_[0] == own_[1])[order])
        end = np.searchsorted(time, time[mine], side="right")
        start = {h: np.searchsorted(time, time[mine] - h * micros, side="left") for h in horizons}
        running = {}
        for spec in set(metrics.values()) - {"count"}:
            v = part.column(spec.split(":")[1]).combine_chunks().cast(pa.float64())
            ok = np.asarray(v.is_valid())[order]
            v = np.where(ok, v.fill_null(0.0).to_numpy(zero_copy_only=False)[order], 0.0)
            running[spec] = (np.concatenate([[0.0], np.cumsum(v)]), np.concatenate([[0], np.cumsum(ok)]))
        cols = []
        for h in horizons:
            for spec in metrics.values():
                if spec == "count":
                    cols.append(pa.array((end - start[h]).astype(np.int64)))
                    continue
                total, count = (c[end] - c[start[h]] for c in running[spec])
                value = total / np.maximum(count, 1) if spec.startswith("avg:") else total
                cols.append(pa.array(value, mask=count == 0))
        rows = part.take(pa.array(order[mine]))
        return pa.table([*[rows.column(c) for c in kept], *cols], names=schema.fieldNames())

    return x.groupBy(key, "_bk").applyInArrow(run, schema)


def shifted_window_features(df: DataFrame, key: str, ts: str, metrics: Mapping[str, str],
                            minutes: int = 15) -> DataFrame:
    """Tumbling-window aggregates per key, with the same metric one window
    earlier (``_pre1``) and the next window one day earlier (``_day_ago_next``).

    One aggregation, then two equi-joins of the (small) window table with
    itself on shifted window starts.
    """
    step = minutes * 60 * 1_000_000
    win = (F.floor(epoch_micros(ts) / F.lit(step)) * F.lit(step)).cast("bigint")
    aggs = []
    for m, spec in metrics.items():
        if spec == "count":
            aggs.append(F.count(F.lit(1)).alias(m))
        else:
            fn, col = spec.split(":")
            aggs.append(getattr(F, fn)(F.col(col)).alias(m))
    g = df.groupBy(key, win.alias("wstart")).agg(*aggs)
    day = 86400 * 1_000_000
    pre = g.select(key, (F.col("wstart") + F.lit(step)).alias("wstart"),
                   *[F.col(m).alias(m + "_pre1") for m in metrics])
    dan = g.select(key, (F.col("wstart") - F.lit(step) + F.lit(day)).alias("wstart"),
                   *[F.col(m).alias(m + "_day_ago_next") for m in metrics])
    return (g.join(pre, [key, "wstart"], "left").join(dan, [key, "wstart"], "left")
             .withColumn("window_start", from_epoch_micros("wstart")).drop("wstart"))


def user_history(orders: DataFrame, user: str, xt: str = "Xt",
                 cancel: str = "canceld", assign: str = "assignd") -> DataFrame:
    """Per user: order, cancel and assign counts; min / avg / max Xt of cancelled
    and of assigned orders (a profile table, one row per user)."""
    c = F.col(cancel) == 1
    a = F.col(assign) == 1
    x = F.col(xt).cast("double")
    return orders.groupBy(user).agg(
        F.count(F.lit(1)).cast("double").alias("ord_num"),
        F.sum(F.col(cancel)).cast("double").alias("ord_cancel_num"),
        F.min(F.when(c, x)).alias("min_cancel_xt"), F.avg(F.when(c, x)).alias("avg_cancel_xt"),
        F.max(F.when(c, x)).alias("max_cancel_xt"),
        F.sum(F.col(assign)).cast("double").alias("ord_assign_num"),
        F.min(F.when(a, x)).alias("min_assign_xt"), F.avg(F.when(a, x)).alias("avg_assign_xt"),
        F.max(F.when(a, x)).alias("max_assign_xt"))


USER_COLUMNS = ["ord_num", "ord_cancel_num", "min_cancel_xt", "avg_cancel_xt", "max_cancel_xt",
                "ord_assign_num", "min_assign_xt", "avg_assign_xt", "max_assign_xt"]


def embedding_lookup(df: DataFrame, ids: str, table: DataFrame, key: str, out: str,
                     id_col: str = "vec_id", vec: str = "embedding", dim: int | None = None) -> DataFrame:
    """id (or list of ids) -> vector; a list is averaged element-wise per row.

    Ids are exploded and joined with the embedding table (broadcast only if
    AQE measures it small); vectors stay whole and are added up by one vector sum
    with map-side partial sums, of any dimension.  Without ``dim`` the longest
    vector's length is read from the table.  Null components are left out of their
    position's average; a row none of whose ids is found has null.  A scalar id is a
    plain join.
    """
    vectors = table.select(F.col(id_col).alias("_id"), F.col(vec).cast("array<double>").alias("_v")).where(F.size("_v") > 0)
    if df.schema[ids].dataType.typeName() != "array":
        j = df.join(vectors, F.col(ids) == F.col("_id"), "left")
        return j.select(*df.columns, F.col("_v").alias(out))
    if dim is None:
        dim = table.agg(F.max(F.size(vec))).first()[0] or 0
    if not dim:
        return df.withColumn(out, F.lit(None).cast("array<double>"))
    # values and a mark of each value that is there, end to end, once per table row
    padded = F.concat("_v", F.array_repeat(F.lit(None).cast("double"), F.lit(dim) - F.size("_v")))
    filled = vectors.select("_id", F.size("_v").alias("_n"), array_to_vector(F.concat(
        F.transform(padded, lambda x: F.coalesce(x, F.lit(0.0))),
        F.transform(padded, lambda x: F.when(x.isNull(), 0.0).otherwise(1.0)))).alias("_f"))
    x = df.select(key, F.explode(ids).alias("_id"))
    a = x.join(filled, "_id").groupBy(key).agg(F.max("_n").alias("_n"), vector_to_array(Summarizer.sum(F.col("_f"))).alias("_s"))
    mean = F.zip_with(F.slice("_s", F.lit(1), F.col("_n")), F.slice("_s", F.lit(dim + 1), F.col("_n")), lambda s, n: F.try_divide(s, n))
    return df.join(a.select(key, mean.alias(out)), key, "left")


def sum_embeddings(cols: Sequence[str], concat_cols: Sequence[str] = ()) -> "F.Column":
    """Element-wise sum of equal-length vectors, then concatenated with others."""
    acc = F.col(cols[0])
    for c in cols[1:]:
        acc = F.zip_with(acc, F.col(c), lambda a, b: a + b)
    return F.concat(acc, *[F.col(c) for c in concat_cols]) if concat_cols else acc
