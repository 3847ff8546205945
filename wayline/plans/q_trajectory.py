"""Registered queries: trajectories (F1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline import fixtures as fx
from wayline.functions.scalars import epoch_micros
from wayline.operators import trajectory as tj
from wayline.plans.oracle_fixtures import POINTS, haversine_sql

HV = haversine_sql("plng", "plat", "lng", "lat")


def q_trip_summary(spark, sf):
    return tj.trip_summary(fx.points(spark, sf))


SQL_TRIP_SUMMARY = f"""
WITH points AS ({POINTS}),
a AS (SELECT trip, lng, lat, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat
      FROM points WINDOW w AS (PARTITION BY trip ORDER BY ts, seq)),
m AS (SELECT trip, lng, lat, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat
      FROM points WHERE spd > 2.5 WINDOW w AS (PARTITION BY trip ORDER BY ts, seq)),
aa AS (SELECT trip, count(*) AS n_points, sum(coalesce({HV}, 0e0)) AS path_m FROM a GROUP BY trip),
mm AS (SELECT trip, count(*) AS n_moving, sum(coalesce({HV}, 0e0)) AS moving_m FROM m GROUP BY trip)
SELECT aa.trip, n_points, coalesce(n_moving, 0) AS n_moving, round(path_m, 3) AS path_m,
       round(coalesce(moving_m, 0e0), 3) AS moving_m
FROM aa LEFT JOIN mm ON aa.trip = mm.trip
"""

QUERIES = {
    "trip_summary": (q_trip_summary, SQL_TRIP_SUMMARY),
}


# ---- cases (#102-106), path length (#107), dwell (#113), stats (#114) -------------

def q_sort_trajectory(spark, sf):
    return tj.sort_trajectory(fx.cases(spark, sf))


SQL_SORT_TRAJECTORY = f"""
WITH points AS ({POINTS})
SELECT trip, CAST(row_number() OVER (PARTITION BY trip ORDER BY ts, lng, lat) AS INTEGER) AS pos, ts, lng, lat, spd, acc
FROM points WHERE trip % 10 <> 0
UNION ALL
SELECT DISTINCT trip, NULL, NULL, NULL, NULL, NULL, NULL FROM points WHERE trip % 10 = 0
"""


def q_moving_path(spark, sf):
    return tj.moving_path(fx.cases(spark, sf))


SQL_MOVING_PATH = f"""
WITH points AS ({POINTS})
SELECT trip, CAST(row_number() OVER (PARTITION BY trip ORDER BY ts, lng, lat) AS INTEGER) AS pos, ts, lng, lat, spd, acc
FROM points WHERE trip % 10 <> 0 AND spd > 2.5
"""


def q_stall_points(spark, sf):
    return tj.stall_points(fx.cases(spark, sf))


SQL_STALL_POINTS = f"""
WITH points AS ({POINTS}),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY trip ORDER BY ts, lng, lat) AS INTEGER) AS pos
      FROM points WHERE trip % 10 <> 0)
SELECT trip, pos, ts, lng, lat, spd, acc FROM s WHERE NOT coalesce(spd > 2.5, FALSE)
"""


def q_stall_clusters(spark, sf):
    from wayline.operators.geo import marker_clusters
    c = marker_clusters(tj.stall_points(fx.cases(spark, sf)), 12)
    return c.select("cx", "cy", "n", F.round("hue", 6).alias("hue"), "size")


_PX = "((lng + 180) / 360e0 * 256 * pow(2e0, 12))"
_PY = "((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256 * pow(2e0, 12))"
SQL_STALL_CLUSTERS = f"""
WITH points AS ({POINTS}),
s AS (SELECT * FROM points WHERE trip % 10 <> 0 AND NOT coalesce(spd > 2.5, FALSE)),
g AS (SELECT CAST(floor({_PX} / 80e0) AS BIGINT) AS cx, CAST(floor({_PY} / 80e0) AS BIGINT) AS cy, count(*) AS n
      FROM s GROUP BY 1, 2),
t AS (SELECT count(*) AS total FROM s)
SELECT cx, cy, n, round(180e0 - 180e0 * pow(n / total, 1 / 18e0), 6) AS hue,
       CAST(round(30e0 + pow(n / total, 1 / 5e0) * 20e0) AS INTEGER) AS size FROM g, t
"""


def q_array_trajectory(spark, sf):
    return tj.array_trajectory(fx.cases(spark, sf))


SQL_ARRAY_TRAJECTORY = f"""
WITH points AS ({POINTS}),
g AS (SELECT trip, round(avg(lng), 4) AS glng, round(avg(lat), 4) AS glat FROM points GROUP BY trip),
t AS (SELECT p.trip, CAST(epoch_us(p.ts) AS VARCHAR) AS ts, CAST(printf('%.6f', p.lng) AS DOUBLE) AS lng,
             CAST(printf('%.6f', p.lat) AS DOUBLE) AS lat,
             CAST(nullif(coalesce(printf('%.4f', p.spd), ''), '') AS DOUBLE) AS spd,
             CAST(printf('%.2f', sqrt(pow(p.lng - g.glng, 2) + pow(p.lat - g.glat, 2)) * 1e5) AS DOUBLE) AS dist2grid
      FROM points p JOIN g ON g.trip = p.trip)
SELECT trip, CAST(row_number() OVER (PARTITION BY trip ORDER BY ts, lng, lat, spd, dist2grid) AS INTEGER) AS pos,
       ts, lng, lat, spd, dist2grid FROM t
"""


def q_case_summary(spark, sf):
    return tj.case_summary(fx.cases(spark, sf))


SQL_CASE_SUMMARY = f"""
WITH points AS ({POINTS}),
c AS (SELECT trip, 'W' || trip AS waybill_code, CAST(count(*) AS INTEGER) AS count,
             (epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7 + 1e0 AS ata,
             min(ts) AS enter_ts, max(ts) AS leave_ts,
             count(CASE WHEN title = 'signup' THEN 1 END) AS req_size,
             string_agg(CASE WHEN title = 'signup' THEN '{{"id":' || seq || ',"ts":' || epoch_us(ts) || '}}' END,
                        '</br>' ORDER BY seq) AS req_json
      FROM points GROUP BY trip)
SELECT trip, waybill_code, count, round(count / ata * 5e0, 2) AS rate, CAST(req_size AS INTEGER) AS req_size,
       concat_ws(',', waybill_code, strftime(enter_ts, '%Y-%m-%d %H:%M:%S.%f'), strftime(leave_ts, '%Y-%m-%d %H:%M:%S.%f'),
                 CAST(count AS VARCHAR),
                 printf('%.2f', count / ata * 5e0)) AS info,
       coalesce(req_json, '') AS req_json
FROM c
"""


def q_path_length(spark, sf):
    p = tj.path_length(fx.points(spark, sf))
    return p.select("trip", F.round("path_m", 3).alias("path_m"), "n_points")


SQL_PATH_LENGTH = f"""
WITH points AS ({POINTS}),
a AS (SELECT trip, lng, lat, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat
      FROM points WINDOW w AS (PARTITION BY trip ORDER BY ts, seq))
SELECT trip, round(sum(coalesce({HV}, 0e0)), 3) AS path_m, count(*) AS n_points FROM a GROUP BY trip
"""


def q_trajectory_stats(spark, sf):
    return tj.trajectory_stats(fx.points(spark, sf), jump_m=5000.0)


SQL_TRAJECTORY_STATS = f"""
WITH points AS ({POINTS}),
a AS (SELECT trip, ts, lng, lat, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat
      FROM points WINDOW w AS (PARTITION BY trip ORDER BY ts, seq))
SELECT trip, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS n_points, CAST(count_if({HV} > 5000e0) AS BIGINT) AS n_jumps,
       round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7 + 1e0), 4) AS freq
FROM a GROUP BY trip
"""


def q_geofence_dwell(spark, sf):
    c = fx.cases(spark, sf).select("trip", F.col("grid_lng").alias("fence_lng"), F.col("grid_lat").alias("fence_lat"))
    d = tj.geofence_dwell(fx.points(spark, sf), c, 8000.0)
    return d


SQL_GEOFENCE_DWELL = f"""
WITH points AS ({POINTS}),
g AS (SELECT trip, round(avg(lng), 4) AS flng, round(avg(lat), 4) AS flat FROM points GROUP BY trip)
SELECT p.trip, min(p.ts) AS enter_ts, max(p.ts) AS leave_ts, count(*) AS n_inside
FROM points p JOIN g ON g.trip = p.trip
WHERE {haversine_sql('p.lng', 'p.lat', 'g.flng', 'g.flat')} <= 8000e0
GROUP BY p.trip
"""

def q_sort_points(spark, sf):
    return tj.sort_points(fx.points(spark, sf))


SQL_SORT_POINTS = f"""
WITH points AS ({POINTS})
SELECT trip, ts, lng, lat, spd, acc, row_number() OVER (PARTITION BY trip ORDER BY ts, lng, lat) AS pos FROM points
"""


def q_moving_points(spark, sf):
    return tj.moving_points(fx.points(spark, sf))


SQL_MOVING_POINTS = f"""
WITH points AS ({POINTS})
SELECT trip, ts, lng, lat, spd, acc, row_number() OVER (PARTITION BY trip ORDER BY ts, lng, lat) AS pos
FROM points WHERE spd > 2.5
"""


def q_stalled_points(spark, sf):
    return tj.stalled_points(fx.points(spark, sf))


SQL_STALLED_POINTS = f"""
SELECT * FROM ({SQL_SORT_POINTS}) WHERE NOT coalesce(spd > 2.5, FALSE)
"""


def q_array_points(spark, sf):
    p = fx.points(spark, sf)
    f = lambda c, d: F.coalesce(F.format_string(f"%.{d}f", F.col(c)), F.lit(""))
    rows = p.select("trip", F.array(f("lng", 6), f("lat", 6), epoch_micros("ts").cast("string"),
                                    F.when(F.col("spd").isNull(), "").otherwise(f("spd", 4)), F.col("acc").cast("string")).alias("grid_traj"))
    return tj.array_points(rows)


SQL_ARRAY_POINTS = f"""
WITH points AS ({POINTS}),
t AS (SELECT trip, CAST(epoch_us(ts) AS VARCHAR) AS ts, CAST(printf('%.6f', lng) AS DOUBLE) AS lng,
             CAST(printf('%.6f', lat) AS DOUBLE) AS lat, CAST(printf('%.4f', spd) AS DOUBLE) AS spd,
             CAST(acc AS DOUBLE) AS dist2grid FROM points)
SELECT trip, ts, lng, lat, spd, dist2grid, row_number() OVER (PARTITION BY trip ORDER BY ts, lng, lat) AS pos FROM t
"""


def q_point_summary(spark, sf):
    return tj.point_summary(fx.points(spark, sf), request=F.col("title") == "signup")


SQL_POINT_SUMMARY = f"""
WITH points AS ({POINTS})
SELECT trip, min(ts) AS enter_ts, max(ts) AS leave_ts, count(*) AS count,
       round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7 + 1e0) * 5e0, 2) AS rate,
       CAST(count_if(title = 'signup') AS BIGINT) AS req_size
FROM points GROUP BY trip
"""

QUERIES.update({
    "sort_points": (q_sort_points, SQL_SORT_POINTS),
    "moving_points": (q_moving_points, SQL_MOVING_POINTS),
    "stalled_points": (q_stalled_points, SQL_STALLED_POINTS),
    "array_points": (q_array_points, SQL_ARRAY_POINTS),
    "point_summary": (q_point_summary, SQL_POINT_SUMMARY),
    "sort_trajectory": (q_sort_trajectory, SQL_SORT_TRAJECTORY),
    "moving_path": (q_moving_path, SQL_MOVING_PATH),
    "stall_points": (q_stall_points, SQL_STALL_POINTS),
    "stall_clusters": (q_stall_clusters, SQL_STALL_CLUSTERS),
    "array_trajectory": (q_array_trajectory, SQL_ARRAY_TRAJECTORY),
    "case_summary": (q_case_summary, SQL_CASE_SUMMARY),
    "path_length": (q_path_length, SQL_PATH_LENGTH),
    "trajectory_stats": (q_trajectory_stats, SQL_TRAJECTORY_STATS),
    "geofence_dwell": (q_geofence_dwell, SQL_GEOFENCE_DWELL),
})
