"""Trajectory operators over points (flat) and cases (nested)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.geo import haversine_m
from wayline.functions.scalars import epoch_micros
from wayline.operators.ordered import RUN, numbered, runs

# Fixed values
MOVING_SPEED = 2.5   # a point is on the moving path when its speed is above this


def sort_trajectory(cases: DataFrame, keep=("trip",), points: str = "tjs") -> DataFrame:
    """Points of each case in time order, one row per point.

    The case's own array is sorted (it is one row already), then exploded with
    its position.  A case whose list is null stays, with a null point.
    """
    keys = list(keep)
    srt = F.array_sort(F.transform(F.col(points), lambda p: F.struct(
        p["ts"].alias("ts"), p["lng"].alias("lng"), p["lat"].alias("lat"),
        p["spd"].alias("spd"), p["acc"].alias("acc"))))
    x = cases.select(*keys, F.posexplode_outer(srt).alias("pos", "p"))
    return x.select(*keys, (F.col("pos") + 1).alias("pos"),
                    *[F.col("p")[c].alias(c) for c in ("ts", "lng", "lat", "spd", "acc")])


def moving_path(cases: DataFrame, keep=("trip",), v: float = MOVING_SPEED,
                points: str = "tjs") -> DataFrame:
    """The path through points with speed strictly above ``v``, in time order."""
    s = sort_trajectory(cases, keep, points)
    return _renumber(s.where(F.col("spd") > F.lit(v)), list(keep))


def stall_points(cases: DataFrame, keep=("trip",), v: float = MOVING_SPEED,
                 points: str = "tjs") -> DataFrame:
    """The complement of ``moving_path``; a null speed counts as stalled."""
    s = sort_trajectory(cases, keep, points)
    return s.where(F.col("lng").isNotNull() & ~F.coalesce(F.col("spd") > F.lit(v), F.lit(False)))


def _renumber(df: DataFrame, keys: list[str]) -> DataFrame:
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy("pos")
    return df.withColumn("pos", F.row_number().over(w))


def array_trajectory(cases: DataFrame, keep=("trip",), col: str = "grid_trajs") -> DataFrame:
    """Points given as string arrays ``[lng, lat, ts, spd, dist2grid]``.

    Cast to numbers and ordered by the third element as given (text order);
    no speed filter.
    """
    keys = list(keep)
    srt = F.array_sort(F.transform(F.col(col), lambda a: F.struct(
        F.element_at(a, 3).alias("ts"),
        F.element_at(a, 1).try_cast("double").alias("lng"),
        F.element_at(a, 2).try_cast("double").alias("lat"),
        F.element_at(a, 4).try_cast("double").alias("spd"),
        F.element_at(a, 5).try_cast("double").alias("dist2grid"))))
    x = cases.select(*keys, F.posexplode(srt).alias("pos", "p"))
    return x.select(*keys, (F.col("pos") + 1).alias("pos"),
                    *[F.col("p")[c].alias(c) for c in ("ts", "lng", "lat", "spd", "dist2grid")])


def case_summary(cases: DataFrame) -> DataFrame:
    """Info line of a case: code, grid times, count, ``count/ata*5`` to 2 decimals,
    number of requests and each request as JSON."""
    rate = F.format_number(F.col("count") / F.col("ata") * F.lit(5.0), 2)
    req_json = F.array_join(F.transform(F.col("req"), lambda r: F.to_json(r)), "</br>")
    info = F.concat_ws(",", F.col("waybill_code"), F.date_format("enter_grid_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
                       F.date_format("leave_grid_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("count").cast("string"),
                       F.regexp_replace(rate, ",", ""))
    return cases.select(
        "trip", "waybill_code", "count",
        F.round(F.col("count") / F.col("ata") * F.lit(5.0), 2).alias("rate"),
        F.size("req").alias("req_size"),
        info.alias("info"),
        req_json.alias("req_json"))


def path_segments(points: DataFrame, key: str = "trip", order=("ts", "seq"), v: float = MOVING_SPEED,
                  jump_m: float = math.inf) -> DataFrame:
    """One row per run and key: the mergeable summary of consecutive points.

    A segment holds its count, first and last point, length and steps over
    ``jump_m``, the same for its moving points (speed above ``v``), and its first and
    last time.  Runs are range partitions, so a trip of any length is cut into
    segments of bounded size; each moving point's step starts at the moving point
    before it.
    """
    order = list(order)
    r = runs(points.select(key, *order, "lng", "lat", "spd"), key, order)
    moving = F.coalesce(F.col("spd") > F.lit(v), F.lit(False))
    at = F.struct("lng", "lat")
    w = Window.partitionBy(RUN, key).orderBy(*order)
    p = r.select("*", moving.alias("_mov"), F.lag(at).over(w).alias("_p"),
                 F.last(F.when(moving, at), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_m"))
    step = haversine_m("_p.lng", "_p.lat", "lng", "lat")
    place = F.struct(*order)
    mplace = F.when(F.col("_mov"), place)
    return p.groupBy(RUN, key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_mov").alias("m_n"),
        F.coalesce(F.sum(step), F.lit(0.0)).alias("len"),
        F.coalesce(F.sum(F.when(F.col("_mov"), haversine_m("_m.lng", "_m.lat", "lng", "lat"))), F.lit(0.0)).alias("m_len"),
        F.count_if(step > F.lit(jump_m)).alias("jumps"),
        F.min_by(at, place).alias("first"), F.max_by(at, place).alias("last"),
        F.min_by(at, mplace).alias("m_first"), F.max_by(at, mplace).alias("m_last"),
        F.min(order[0]).alias("t_first"), F.max(order[0]).alias("t_last"))


def merged_segments(segments: DataFrame, key: str = "trip", jump_m: float = math.inf) -> DataFrame:
    """Segments of a key in run order merged to one: lengths add up, and so do the
    steps from each segment's last point to the next one's first.

    A key has at most as many segments as there are partitions.
    """
    w = Window.partitionBy(key).orderBy(RUN)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = segments.select("*", F.lag("last").over(w).alias("_p"), F.last("m_last", ignorenulls=True).over(before).alias("_m"))
    gap = haversine_m("_p.lng", "_p.lat", "first.lng", "first.lat")
    m_gap = haversine_m("_m.lng", "_m.lat", "m_first.lng", "m_first.lat")
    return s.groupBy(key).agg(
        F.sum("n").alias("n_points"), F.sum("m_n").alias("n_moving"),
        F.sum(F.col("len") + F.coalesce(gap, F.lit(0.0))).alias("path_m"),
        F.sum(F.col("m_len") + F.coalesce(m_gap, F.lit(0.0))).alias("moving_m"),
        (F.sum("jumps") + F.count_if(gap > F.lit(jump_m))).alias("n_jumps"),
        F.min("t_first").alias("min_ts"), F.max("t_last").alias("max_ts"))


def path_length(points: DataFrame, key: str = "trip", order=("ts", "seq"), out: str = "path_m") -> DataFrame:
    """Measured distance along ordered points per key (great-circle, metres)."""
    src = points if "spd" in points.columns else points.withColumn("spd", F.lit(None).cast("double"))
    m = merged_segments(path_segments(src, key, order), key)
    return m.select(key, F.col("path_m").alias(out), "n_points")


def trip_summary(points: DataFrame, v: float = MOVING_SPEED, key: str = "trip") -> DataFrame:
    """Per trip: points, moving points, full path length and moving-path length.

    Both lengths come from one pass over range-partitioned points; segments are
    merged per trip.
    """
    m = merged_segments(path_segments(points, key, v=v), key)
    return m.select(key, "n_points", "n_moving", F.round("path_m", 3).alias("path_m"), F.round("moving_m", 3).alias("moving_m"))


def trajectory_stats(points: DataFrame, key: str = "trip", jump_m: float = 1000.0) -> DataFrame:
    """First / last time, point count, frequency (points per minute) and jumps
    (steps longer than ``jump_m`` metres)."""
    src = points if "spd" in points.columns else points.withColumn("spd", F.lit(None).cast("double"))
    g = merged_segments(path_segments(src, key, jump_m=jump_m), key, jump_m)
    span_min = (epoch_micros("max_ts") - epoch_micros("min_ts")) / F.lit(6e7)
    return g.select(key, "min_ts", "max_ts", "n_points", "n_jumps",
                    F.round(F.col("n_points") / (span_min + F.lit(1.0)), 4).alias("freq"))


def sort_points(points: DataFrame, key: str = "trip", order=("ts", "lng", "lat", "spd", "acc"),
                where: Column | None = None) -> DataFrame:
    """Flat form of ``sort_trajectory``: each key's points numbered in time order.

    A key of any length stays spread: no point list is gathered.  ``where`` keeps
    some points before they are numbered.
    """
    src = points if where is None else points.where(where)
    return numbered(src.select(key, *order), list(order), [key], "pos")


def moving_points(points: DataFrame, key: str = "trip", v: float = MOVING_SPEED) -> DataFrame:
    """Flat form of ``moving_path``."""
    return sort_points(points, key, where=F.col("spd") > F.lit(v))


def stalled_points(points: DataFrame, key: str = "trip", v: float = MOVING_SPEED) -> DataFrame:
    """Flat form of ``stall_points``: positions are those among all points of the key."""
    s = sort_points(points, key)
    return s.where(~F.coalesce(F.col("spd") > F.lit(v), F.lit(False)))


def array_points(rows: DataFrame, key: str = "trip", col: str = "grid_traj") -> DataFrame:
    """Flat form of ``array_trajectory``: one string array ``[lng, lat, ts, spd, dist2grid]`` per row."""
    num = lambda i: F.element_at(col, i).try_cast("double")
    p = rows.select(key, F.element_at(col, 3).alias("ts"), num(1).alias("lng"), num(2).alias("lat"),
                    num(4).alias("spd"), num(5).alias("dist2grid"))
    return numbered(p, ["ts", "lng", "lat", "spd", "dist2grid"], [key], "pos")


def point_summary(points: DataFrame, key: str = "trip", request: Column | None = None) -> DataFrame:
    """Numbers of ``case_summary`` from flat points: count, rate and number of requests."""
    asked = F.count_if(request) if request is not None else F.lit(0).cast("bigint")
    g = points.groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.min("ts").alias("enter_ts"), F.max("ts").alias("leave_ts"),
                                asked.alias("req_size"))
    minutes = (epoch_micros("leave_ts") - epoch_micros("enter_ts")) / F.lit(6e7) + F.lit(1.0)
    return g.select(key, "enter_ts", "leave_ts", "count", F.round(F.col("count") / minutes * F.lit(5.0), 2).alias("rate"), "req_size")


def geofence_dwell(points: DataFrame, fences: DataFrame, r_m: float, key: str = "trip") -> DataFrame:
    """Enter and leave time of each key's fence: first and last point within ``r_m``.

    ``fences`` has one row per key (``key, fence_lng, fence_lat``); it is
    joined on the key, so it partitions with the points.
    """
    j = points.join(fences, key)
    near = j.where(haversine_m("lng", "lat", "fence_lng", "fence_lat") <= F.lit(r_m))
    return near.groupBy(key).agg(F.min("ts").alias("enter_ts"), F.max("ts").alias("leave_ts"),
                                 F.count(F.lit(1)).alias("n_inside"))
