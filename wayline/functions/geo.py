"""Geo column functions: distances, Web-Mercator, hexagons, tiles, parsing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
EARTH_RADIUS_M = 6371000.0       # mean radius for great-circle distance
MERCATOR_RADIUS_M = 6378137.0    # Web-Mercator sphere
TILE_PX = 256                    # slippy tile size in pixels


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def haversine_m(lng1, lat1, lng2, lat2) -> Column:
    """Great-circle distance in metres."""
    lng1, lat1, lng2, lat2 = map(_c, (lng1, lat1, lng2, lat2))
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp = p2 - p1
    dl = F.radians(lng2) - F.radians(lng1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def mercator_x(lng) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.radians(_c(lng))


def mercator_y(lat) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(_c(lat)) / 2))


def mercator_lng(x) -> Column:
    return F.degrees(_c(x) / F.lit(MERCATOR_RADIUS_M))


def mercator_lat(y) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(_c(y) / F.lit(MERCATOR_RADIUS_M))) - F.lit(math.pi / 2))


def hex_axial(lng, lat, size) -> Column:
    """Pointy-top axial hex ``struct(q, r)`` of a point; ``size`` is the hex radius in metres.

    Fractional axial coordinates from Web-Mercator metres, then cube rounding.
    """
    size = _c(size).cast("double")
    x, y = mercator_x(lng), mercator_y(lat)
    qf = (F.lit(math.sqrt(3) / 3) * x - F.lit(1 / 3) * y) / size
    rf = (F.lit(2 / 3) * y) / size
    sf = -qf - rf
    rq, rr, rs = F.round(qf), F.round(rf), F.round(sf)
    dq, dr, ds = F.abs(rq - qf), F.abs(rr - rf), F.abs(rs - sf)
    q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    r = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return F.struct(q.cast("bigint").alias("q"), r.cast("bigint").alias("r"))


def proj_hex(lng, lat, size) -> Column:
    """Hex id ``"size:q:r"`` (the SQL function ``proj_hex``)."""
    h = hex_axial(lng, lat, size)
    return F.concat_ws(":", _c(size).cast("bigint").cast("string"),
                       h["q"].cast("string"), h["r"].cast("string"))


def hex_center(q, r, size) -> Column:
    """Centre ``struct(lng, lat)`` of axial hex (q, r)."""
    q, r, size = _c(q), _c(r), _c(size).cast("double")
    x = size * F.lit(math.sqrt(3)) * (q + r / 2)
    y = size * F.lit(1.5) * r
    return F.struct(mercator_lng(x).alias("lng"), mercator_lat(y).alias("lat"))


def hex_vertices(q, r, size) -> Column:
    """Six corners (pointy top, from -30 degrees) as ``array<struct(lng, lat)>``."""
    q, r, size = _c(q), _c(r), _c(size).cast("double")
    cx = size * F.lit(math.sqrt(3)) * (q + r / 2)
    cy = size * F.lit(1.5) * r
    pts = []
    for i in range(6):
        a = math.radians(60 * i - 30)
        pts.append(F.struct(mercator_lng(cx + size * F.lit(math.cos(a))).alias("lng"),
                            mercator_lat(cy + size * F.lit(math.sin(a))).alias("lat")))
    return F.array(*pts)


def world_pixel(lng, lat, zoom) -> Column:
    """Global pixel ``struct(x, y)`` at ``zoom`` (256-pixel slippy tiles)."""
    scale = F.lit(float(TILE_PX)) * F.pow(F.lit(2.0), _c(zoom).cast("double"))
    phi = F.radians(_c(lat))
    x = (_c(lng) + F.lit(180.0)) / F.lit(360.0) * scale
    y = (F.lit(1.0) - F.ln(F.tan(phi) + F.lit(1.0) / F.cos(phi)) / F.lit(math.pi)) / F.lit(2.0) * scale
    return F.struct(x.alias("x"), y.alias("y"))


def lnglat_to_tile(lng, lat, zoom) -> Column:
    """Slippy tile ``struct(z, x, y)`` containing the point."""
    p = world_pixel(lng, lat, zoom)
    return F.struct(_c(zoom).cast("int").alias("z"),
                    F.floor(p["x"] / F.lit(float(TILE_PX))).cast("bigint").alias("x"),
                    F.floor(p["y"] / F.lit(float(TILE_PX))).cast("bigint").alias("y"))


def parse_point(text) -> Column:
    """``"lng,lat"`` -> ``struct(lng, lat)``; malformed text gives nulls."""
    parts = F.split(F.trim(_c(text)), ",")
    return F.struct(F.try_element_at(parts, F.lit(1)).try_cast("double").alias("lng"),
                    F.try_element_at(parts, F.lit(2)).try_cast("double").alias("lat"))


def parse_path(text) -> Column:
    """``"lng,lat;lng,lat"`` -> ``array<struct(lng, lat)>`` (empty parts skipped)."""
    parts = F.filter(F.split(_c(text), ";"), lambda s: F.trim(s) != "")
    return F.transform(parts, lambda s: F.struct(
        F.try_element_at(F.split(F.trim(s), ","), F.lit(1)).try_cast("double").alias("lng"),
        F.try_element_at(F.split(F.trim(s), ","), F.lit(2)).try_cast("double").alias("lat")))


def parse_polyline_text(text) -> Column:
    """``"lng lat,lng lat"`` -> ``array<struct(lat, lng)>`` (latitude first)."""
    parts = F.split(_c(text), ",")
    return F.transform(parts, lambda s: F.struct(
        F.try_element_at(F.split(F.trim(s), " "), F.lit(2)).try_cast("double").alias("lat"),
        F.try_element_at(F.split(F.trim(s), " "), F.lit(1)).try_cast("double").alias("lng")))


def color_ramp(g) -> Column:
    """Grey level 0-1 -> ``rgb(...)``: green-blue below 0.5, red-yellow from 0.5."""
    g = _c(g).cast("double")
    lo = F.format_string("rgb(0,255,%d)", F.floor(F.lit(255.0) * (F.lit(1.0) - F.lit(2.0) * g)).cast("int"))
    hi = F.format_string("rgb(255,%d,0)", F.floor(F.lit(255.0) * F.lit(2.0) * (F.lit(1.0) - g)).cast("int"))
    return F.when(g < 0.5, lo).otherwise(hi)
