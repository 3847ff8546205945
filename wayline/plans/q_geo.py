"""Registered queries: geo parsing, tiles, hex layers, clusters, heat, top-n, codec (#91-101, #111)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline import fixtures as fx
from wayline.functions import geo as g
from wayline.operators import geo as og
from wayline.operators import polyline as pl
from wayline.operators.nearby import nearby_stats
from wayline.operators.ordered import written
from wayline.plans.oracle_fixtures import POINTS, haversine_sql
from wayline.plans.q_sql import hex_sql

def _hour():
    return F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")


def geo_texts(spark, sf):
    """F8: per (trip, hour) the path as ``lng,lat;...`` and as ``lng lat,...`` text."""
    p = fx.points(spark, sf)
    s = F.array_sort(F.collect_list(F.struct("ts", "seq", F.format_string("%.5f", "lng").alias("x"),
                                             F.format_string("%.5f", "lat").alias("y"))))
    grp = p.groupBy("trip", _hour().alias("hour")).agg(s.alias("_s"))
    return grp.select(
        "trip", "hour",
        F.array_join(F.transform("_s", lambda r: F.concat_ws(",", r["x"], r["y"])), ";").alias("path_text"),
        F.array_join(F.transform("_s", lambda r: F.concat_ws(" ", r["x"], r["y"])), ",").alias("polyline_text"),
        F.concat_ws(",", F.element_at("_s", 1)["x"], F.element_at("_s", 1)["y"]).alias("first_point"))


_POINTS_ORDERED = f"""
  points AS ({POINTS}),
  o AS (SELECT trip, date_trunc('hour', ts) AS hour, seq,
               CAST(printf('%.5f', lng) AS DOUBLE) AS lng, CAST(printf('%.5f', lat) AS DOUBLE) AS lat,
               CAST(row_number() OVER (PARTITION BY trip, date_trunc('hour', ts) ORDER BY ts, seq) AS INTEGER) AS pos
        FROM points)"""


def q_parse_path(spark, sf):
    t = geo_texts(spark, sf)
    x = t.select("trip", "hour", F.posexplode(g.parse_path("path_text")).alias("pos", "p"),
                 g.parse_point("first_point").alias("fp"))
    return x.select("trip", "hour", (F.col("pos") + 1).alias("pos"), F.col("p.lng").alias("lng"),
                    F.col("p.lat").alias("lat"),
                    (F.col("fp.lng") == F.col("p.lng")).cast("int").alias("same_lng_as_first"))


SQL_PARSE_PATH = f"""
WITH {_POINTS_ORDERED},
  f AS (SELECT trip, hour, lng AS flng FROM o WHERE pos = 1)
SELECT o.trip, o.hour, o.pos, o.lng, o.lat, CAST(o.lng = f.flng AS INTEGER) AS same_lng_as_first
FROM o JOIN f ON f.trip = o.trip AND f.hour = o.hour
"""


def q_parse_polyline_text(spark, sf):
    t = geo_texts(spark, sf)
    x = t.select("trip", "hour", F.posexplode(g.parse_polyline_text("polyline_text")).alias("pos", "p"))
    return x.select("trip", "hour", (F.col("pos") + 1).alias("pos"), F.col("p.lat").alias("lat"),
                    F.col("p.lng").alias("lng"))


SQL_PARSE_POLYLINE_TEXT = f"WITH {_POINTS_ORDERED}\nSELECT trip, hour, pos, lat, lng FROM o"

ZOOM = 12


def q_lnglat_to_tile(spark, sf):
    p = fx.points(spark, sf)
    t = g.lnglat_to_tile("lng", "lat", ZOOM)
    px = g.world_pixel("lng", "lat", ZOOM)
    return p.select("seq", t["z"].alias("z"), t["x"].alias("x"), t["y"].alias("y"),
                    F.round(px["x"], 3).alias("px"), F.round(px["y"], 3).alias("py"))


_PX = f"((lng + 180) / 360e0 * 256 * pow(2e0, {ZOOM}))"
_PY = f"((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256 * pow(2e0, {ZOOM}))"

SQL_LNGLAT_TO_TILE = f"""
WITH points AS ({POINTS})
SELECT seq, {ZOOM} AS z, CAST(floor({_PX} / 256) AS BIGINT) AS x, CAST(floor({_PY} / 256) AS BIGINT) AS y,
       round({_PX}, 3) AS px, round({_PY}, 3) AS py FROM points
"""

HEX_SIZE = 1000.0


def q_hex_layer(spark, sf):
    layer = og.hex_layer(fx.points(spark, sf), HEX_SIZE)
    return layer.select("HexID", "n", "center", "polygeo", "color", F.array_join("desc", "</br>").alias("desc"))


def _hex_center_sql(q: str, r: str, size: str) -> tuple[str, str]:
    x = f"({size} * sqrt(3e0) * ({q} + {r} / 2e0))"
    y = f"({size} * 1.5e0 * {r})"
    return (f"degrees({x} / 6378137e0)", f"degrees(2 * atan(exp({y} / 6378137e0)) - pi() / 2)")


def _hex_vertices_sql(size: str) -> str:
    import math
    parts = []
    for i in range(6):
        a = math.radians(60 * i - 30)
        cx = f"({size} * sqrt(3e0) * (q + r / 2e0) + {size} * {math.cos(a)!r})"
        cy = f"({size} * 1.5e0 * r + {size} * {math.sin(a)!r})"
        parts.append(f"printf('%.6f,%.6f', degrees({cx} / 6378137e0), "
                     f"degrees(2 * atan(exp({cy} / 6378137e0)) - pi() / 2))")
    return " || ';' || ".join(parts)


_CLNG, _CLAT = _hex_center_sql("q", "r", "1000e0")
SQL_HEX_LAYER = f"""
WITH points AS ({POINTS}),
h AS (SELECT string_split({hex_sql('lng', 'lat', '1000e0')}, ':') AS parts FROM points),
g AS (SELECT CAST(parts[2] AS BIGINT) AS q, CAST(parts[3] AS BIGINT) AS r, count(*) AS n FROM h GROUP BY 1, 2),
m AS (SELECT max(n) AS mx FROM g)
SELECT '1000_' || q || '_' || r AS HexID, n,
       printf('%.6f,%.6f', {_CLNG}, {_CLAT}) AS center,
       {_hex_vertices_sql('1000e0')} AS polygeo,
       CASE WHEN n / mx < 0.5 THEN printf('rgb(0,255,%d)', CAST(floor(255e0 * (1 - 2e0 * (n / mx))) AS INTEGER))
            ELSE printf('rgb(255,%d,0)', CAST(floor(255e0 * 2e0 * (1 - n / mx)) AS INTEGER)) END AS color,
       'n=' || n AS desc
FROM g, m
"""


def q_hex_select(spark, sf):
    layer = og.hex_layer(fx.points(spark, sf), HEX_SIZE)
    # the user's id list: hexes of four fixed places, separated as typed on the page
    places = spark.createDataFrame([(116.10, 39.70), (116.20, 39.80), (116.30, 39.90), (116.40, 40.00)],
                                   "lng double, lat double")
    ids = [r[0] for r in places.select(og.hex_id(HEX_SIZE, g.hex_axial("lng", "lat", HEX_SIZE)["q"],
                                                  g.hex_axial("lng", "lat", HEX_SIZE)["r"])).collect()]
    text = ids[0] + "," + ids[1] + " " + ids[2] + "\n" + ids[3]
    return og.hex_select(layer, text).select("HexID", "n")


SQL_HEX_SELECT = f"""
WITH points AS ({POINTS}),
h AS (SELECT replace({hex_sql('lng', 'lat', '1000e0')}, ':', '_') AS HexID FROM points),
sel AS (SELECT replace({hex_sql('lng', 'lat', '1000e0')}, ':', '_') AS HexID
        FROM (VALUES (116.10e0, 39.70e0), (116.20e0, 39.80e0), (116.30e0, 39.90e0), (116.40e0, 40.00e0)) v(lng, lat))
SELECT HexID, count(*) AS n FROM h WHERE HexID IN (SELECT HexID FROM sel) GROUP BY HexID
"""


def q_marker_clusters(spark, sf):
    c = og.marker_clusters(fx.points(spark, sf), ZOOM)
    return c.select("cx", "cy", "n", F.round("center_lng", 6).alias("center_lng"),
                    F.round("center_lat", 6).alias("center_lat"), F.round("hue", 6).alias("hue"), "size")


SQL_MARKER_CLUSTERS = f"""
WITH points AS ({POINTS}),
c AS (SELECT CAST(floor({_PX} / 80e0) AS BIGINT) AS cx, CAST(floor({_PY} / 80e0) AS BIGINT) AS cy, lng, lat FROM points),
g AS (SELECT cx, cy, count(*) AS n, avg(lng) AS clng, avg(lat) AS clat FROM c GROUP BY 1, 2),
t AS (SELECT count(*) AS total FROM points)
SELECT cx, cy, n, round(clng, 6) AS center_lng, round(clat, 6) AS center_lat,
       round(180e0 - 180e0 * pow(n / total, 1 / 18e0), 6) AS hue,
       CAST(round(30e0 + pow(n / total, 1 / 5e0) * 20e0) AS INTEGER) AS size
FROM g, t
"""


def q_heat_grid(spark, sf):
    p = fx.points(spark, sf).withColumn("w", F.col("acc").cast("double"))
    h = og.heat_grid(p, 0.05, 100, weight="w")
    return h.select("gx", "gy", "weight", F.round("intensity", 6).alias("intensity"))


SQL_HEAT_GRID = f"""
WITH points AS ({POINTS})
SELECT CAST(floor(lng / 0.05e0) AS BIGINT) AS gx, CAST(floor(lat / 0.05e0) AS BIGINT) AS gy,
       sum(CAST(acc AS DOUBLE)) AS weight, round(least(sum(CAST(acc AS DOUBLE)), 100e0) / 100e0, 6) AS intensity
FROM points GROUP BY 1, 2
"""


def q_top_n_per_cell(spark, sf):
    p = fx.points(spark, sf)
    cells = p.select("seq", F.floor(F.col("lng") / F.lit(0.02)).cast("bigint").alias("gx"),
                     F.floor(F.col("lat") / F.lit(0.02)).cast("bigint").alias("gy"))
    t = og.top_n_per_group(cells, ["gx", "gy"], ["seq"], 3)
    return t.select("gx", "gy", "seq", "rank")


SQL_TOP_N_PER_CELL = f"""
WITH points AS ({POINTS}),
c AS (SELECT seq, CAST(floor(lng / 0.02e0) AS BIGINT) AS gx, CAST(floor(lat / 0.02e0) AS BIGINT) AS gy FROM points)
SELECT gx, gy, seq, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY seq) AS rank FROM c) WHERE rank <= 3
"""


#: A cell and a marker on the page, in pixels.
CELL_PX, MARKER_PX = 40, 20


def q_top_n_per_cell_auto(spark, sf):
    """The number of points shown in a cell follows from the room that cell and marker take."""
    cells = fx.points(spark, sf).select("seq", F.floor(F.col("lng") / F.lit(0.02)).cast("bigint").alias("gx"),
                                        F.floor(F.col("lat") / F.lit(0.02)).cast("bigint").alias("gy"))
    n = og.auto_top_n(CELL_PX ** 2, MARKER_PX ** 2)
    return og.top_n_per_group(cells, ["gx", "gy"], ["seq"], n).select("gx", "gy", "seq", "rank")


SQL_TOP_N_PER_CELL_AUTO = f"""
WITH points AS ({POINTS}),
c AS (SELECT seq, CAST(floor(lng / 0.02e0) AS BIGINT) AS gx, CAST(floor(lat / 0.02e0) AS BIGINT) AS gy FROM points)
SELECT gx, gy, seq, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY seq) AS rank FROM c)
WHERE rank <= greatest(3, ceil(1.5e0 * {CELL_PX} * {CELL_PX} / ({MARKER_PX} * {MARKER_PX})))
"""


def q_color_ramp(spark, sf):
    e = fx.points(spark, sf)
    return e.select("seq", g.color_ramp(F.col("acc") / F.lit(100.0)).alias("color"))


SQL_COLOR_RAMP = f"""
WITH points AS ({POINTS})
SELECT seq, CASE WHEN acc / 100e0 < 0.5 THEN printf('rgb(0,255,%d)', CAST(floor(255e0 * (1 - 2e0 * (acc / 100e0))) AS INTEGER))
                 ELSE printf('rgb(255,%d,0)', CAST(floor(255e0 * 2e0 * (1 - acc / 100e0)) AS INTEGER)) END AS color
FROM points
"""


def q_nearby_stats(spark, sf):
    p = fx.points(spark, sf)
    orders = p.where(F.col("seq") % 2 == 0).select(F.col("seq").alias("oid"), "lng", "lat")
    cars = p.where(F.col("seq") % 2 == 1).select(F.col("seq").alias("car"), "lng", "lat")
    n = nearby_stats(orders, cars, 3000.0, key="oid")
    return n.select("oid", "n_cars", F.round("min_dist", 3).alias("min_dist"), F.round("avg_dist", 3).alias("avg_dist"))


SQL_NEARBY_STATS = f"""
WITH points AS ({POINTS}),
o AS (SELECT seq AS oid, lng, lat FROM points WHERE seq % 2 = 0),
c AS (SELECT seq AS car, lng AS clng, lat AS clat FROM points WHERE seq % 2 = 1),
d AS (SELECT o.oid, {haversine_sql('o.lng', 'o.lat', 'c.clng', 'c.clat')} AS dist FROM o, c
      WHERE abs(o.lat - c.clat) < 0.05 AND abs(o.lng - c.clng) < 0.07)
SELECT o.oid, count(d.dist) AS n_cars, round(min(d.dist), 3) AS min_dist, round(avg(d.dist), 3) AS avg_dist
FROM o LEFT JOIN d ON d.oid = o.oid AND d.dist <= 3000e0 GROUP BY o.oid
"""


# ---- codec (#93, #94) -----------------------------------------------------------------

def q_encode_points(spark, sf):
    e = pl.encode_points(fx.points(spark, sf))
    return e.select("trip", "seq", "ilat", "ilng", "index", "code")


# Fixed value in the text: the 64-character code table of the path format
_ENC = f"""
  points AS ({POINTS}),
  r AS (SELECT trip, seq, ts, CAST(round(lat * 100000e0) AS BIGINT) AS ilat, CAST(round(lng * 100000e0) AS BIGINT) AS ilng
        FROM points),
  d AS (SELECT *, ilat - coalesce(lag(ilat) OVER w, 0) AS dx, ilng - coalesce(lag(ilng) OVER w, 0) AS dy
        FROM r WINDOW w AS (PARTITION BY trip ORDER BY ts, seq)),
  z AS (SELECT *, CASE WHEN dx < 0 THEN -2 * dx - 1 ELSE 2 * dx END AS zx,
                 CASE WHEN dy < 0 THEN -2 * dy - 1 ELSE 2 * dy END AS zy FROM d),
  ix AS (SELECT *, CAST((zx + zy) * (zx + zy + 1) // 2 + zx AS BIGINT) AS idx FROM z),
  nd AS (SELECT *, CAST(len(list_filter(range(13), lambda k: (idx >> (5 * k)) > 0)) AS BIGINT) AS ndig FROM ix),
  c AS (SELECT trip, seq, ts, ilat, ilng, idx AS index,
               array_to_string(list_transform(range(ndig), lambda k: substr(
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-',
                 CAST(((idx >> (5 * k)) & 31) + CASE WHEN k < ndig - 1 THEN 32 ELSE 0 END + 1 AS INTEGER), 1)), '') AS code
        FROM nd)"""

SQL_ENCODE_POINTS = f"WITH {_ENC}\nSELECT trip, seq, ilat, ilng, index, code FROM c"


def q_encode_polylines(spark, sf):
    return pl.encode_polylines(fx.points(spark, sf))


SQL_ENCODE_POLYLINES = f"WITH {_ENC}\nSELECT trip, string_agg(code, '' ORDER BY ts, seq) AS text FROM c GROUP BY trip"


def q_decode_polylines(spark, sf):
    return pl.decode_polylines(pl.encode_polylines(fx.points(spark, sf))).select("trip", "k", "lat", "lng")


SQL_DECODE_POLYLINES = f"""
WITH {_ENC},
  k AS (SELECT trip, ilat, ilng, row_number() OVER (PARTITION BY trip ORDER BY ts, seq) AS k FROM c WHERE index <> 0)
SELECT trip, k, ilat / 100000e0 AS lat, ilng / 100000e0 AS lng FROM k
"""

#: Points of a chunk in the two queries below: small, so trips have several chunks.
CHUNK = 16


def q_encode_chunks(spark, sf):
    return pl.encode_chunks(fx.points(spark, sf), size=CHUNK)


SQL_ENCODE_CHUNKS = f"""
WITH {_ENC},
p AS (SELECT *, row_number() OVER w AS pos, lag(ilat) OVER w AS pa, lag(ilng) OVER w AS po FROM c WINDOW w AS (PARTITION BY trip ORDER BY ts, seq))
SELECT trip, CAST((pos - 1) // {CHUNK} AS BIGINT) AS chunk, coalesce(arg_min(coalesce(pa, 0), pos), 0) AS start_lat,
       coalesce(arg_min(coalesce(po, 0), pos), 0) AS start_lng, count(*) AS n, string_agg(code, '' ORDER BY pos) AS text
FROM p GROUP BY 1, 2
"""


def q_decode_chunks(spark, sf):
    """Chunks written as a table and decoded again, each by itself."""
    return pl.decode_chunks(written(pl.encode_chunks(fx.points(spark, sf), size=CHUNK), "chunks"))


SQL_DECODE_CHUNKS = f"""
WITH {_ENC},
p AS (SELECT *, (row_number() OVER (PARTITION BY trip ORDER BY ts, seq) - 1) // {CHUNK} AS chunk FROM c),
k AS (SELECT trip, CAST(chunk AS BIGINT) AS chunk, ilat, ilng, row_number() OVER (PARTITION BY trip, chunk ORDER BY ts, seq) AS k FROM p WHERE index <> 0)
SELECT trip, chunk, k, ilat / 100000e0 AS lat, ilng / 100000e0 AS lng FROM k
"""

QUERIES = {
    "encode_chunks": (q_encode_chunks, SQL_ENCODE_CHUNKS),
    "decode_chunks": (q_decode_chunks, SQL_DECODE_CHUNKS),
    "parse_path": (q_parse_path, SQL_PARSE_PATH),
    "parse_polyline_text": (q_parse_polyline_text, SQL_PARSE_POLYLINE_TEXT),
    "lnglat_to_tile": (q_lnglat_to_tile, SQL_LNGLAT_TO_TILE),
    "hex_layer": (q_hex_layer, SQL_HEX_LAYER),
    "hex_select": (q_hex_select, SQL_HEX_SELECT),
    "marker_clusters": (q_marker_clusters, SQL_MARKER_CLUSTERS),
    "heat_grid": (q_heat_grid, SQL_HEAT_GRID),
    "top_n_per_cell": (q_top_n_per_cell, SQL_TOP_N_PER_CELL),
    "top_n_per_cell_auto": (q_top_n_per_cell_auto, SQL_TOP_N_PER_CELL_AUTO),
    "color_ramp": (q_color_ramp, SQL_COLOR_RAMP),
    "nearby_stats": (q_nearby_stats, SQL_NEARBY_STATS),
    "encode_points": (q_encode_points, SQL_ENCODE_POINTS),
    "encode_polylines": (q_encode_polylines, SQL_ENCODE_POLYLINES),
    "decode_polylines": (q_decode_polylines, SQL_DECODE_POLYLINES),
}
