"""Geo layers over points: hexagons, marker clusters, heat grids, top-n per cell."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.geo import color_ramp, hex_axial, hex_center, hex_vertices, world_pixel

# Fixed values
CLUSTER_GRID_PX = 80
HEAT_CAP = 100
HEX_SELECT_SEPARATORS = ",| |:|\n"


def hex_id(size: float, q: Column, r: Column) -> Column:
    """Layer id ``size_q_r`` (no separator of ``hex_select`` inside)."""
    return F.concat_ws("_", F.lit(str(int(size))), q.cast("string"), r.cast("string"))


def hex_layer(points: DataFrame, size: float, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """Points per hex -> ``{HexID, center, polygeo, color, desc}`` records.

    ``color`` is the ramp of ``n / max(n)``; the maximum is a scalar subquery
    over the per-hex table, whose exchange both uses share.
    """
    h = points.select(hex_axial(lng, lat, size).alias("h"))
    g = h.groupBy(F.col("h.q").alias("q"), F.col("h.r").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    mx = g.agg(F.max("n").cast("double")).scalar()
    c = hex_center("q", "r", size)
    poly = hex_vertices("q", "r", size)
    return g.select(
        hex_id(size, F.col("q"), F.col("r")).alias("HexID"), "q", "r", "n",
        F.format_string("%.6f,%.6f", c["lng"], c["lat"]).alias("center"),
        F.array_join(F.transform(poly, lambda p: F.format_string("%.6f,%.6f", p["lng"], p["lat"])), ";")
         .alias("polygeo"),
        color_ramp(F.col("n") / mx).alias("color"),
        F.array(F.concat(F.lit("n="), F.col("n").cast("string"))).alias("desc"))


def hex_records_json(layer: DataFrame) -> DataFrame:
    """One JSON text per hex record (what the map page reads)."""
    return layer.select(F.to_json(F.struct("HexID", "center", "polygeo", "color", "desc")).alias("json"))


def hex_select(layer: DataFrame, text: str, sep: str = HEX_SELECT_SEPARATORS) -> DataFrame:
    """Records whose id is listed in ``text`` (split on ``,`` space ``:`` newline): a left semi join."""
    spark = layer.sparkSession
    ids = spark.createDataFrame([(text,)], "t string").select(F.explode(F.split("t", sep)).alias("HexID"))
    ids = ids.where(F.col("HexID") != "").distinct()
    return layer.join(ids, "HexID", "left_semi")


def marker_clusters(points: DataFrame, zoom: int, grid: int = CLUSTER_GRID_PX,
                    lng: str = "lng", lat: str = "lat") -> DataFrame:
    """Grid clusters of ``grid`` pixels at ``zoom``: count, centre, hue and size.

    Hue ``180 - 180 (n/N)^(1/18)``, size ``round(30 + 20 (n/N)^(1/5))`` with
    N the number of points (the sum over the clusters, a scalar subquery).
    """
    p = points.where(F.col(lng).isNotNull() & F.col(lat).isNotNull())
    px = world_pixel(lng, lat, zoom)
    cell = p.select(F.floor(px["x"] / F.lit(float(grid))).cast("bigint").alias("cx"),
                    F.floor(px["y"] / F.lit(float(grid))).cast("bigint").alias("cy"), lng, lat)
    g = cell.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.avg(lng).alias("center_lng"),
                                     F.avg(lat).alias("center_lat"))
    share = F.col("n") / g.agg(F.sum("n").cast("double")).scalar()
    return g.select("cx", "cy", "n", "center_lng", "center_lat",
                    (F.lit(180.0) - F.lit(180.0) * F.pow(share, 1 / 18)).alias("hue"),
                    F.round(F.lit(30.0) + F.pow(share, 1 / 5) * F.lit(20.0)).cast("int").alias("size"))


def heat_grid(points: DataFrame, cell_deg: float, cap: int = HEAT_CAP, lng: str = "lng",
              lat: str = "lat", weight: str | None = None) -> DataFrame:
    """Weighted points per cell, capped at ``cap``; intensity ``min(w, cap) / cap``."""
    w = F.col(weight) if weight else F.lit(1.0)
    g = points.groupBy(F.floor(F.col(lng) / F.lit(cell_deg)).cast("bigint").alias("gx"),
                       F.floor(F.col(lat) / F.lit(cell_deg)).cast("bigint").alias("gy")) \
        .agg(F.sum(w).alias("weight"))
    return g.withColumn("intensity", F.least(F.col("weight"), F.lit(float(cap))) / F.lit(float(cap)))


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence, n: int,
                    salts: int = 16, salt_key: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group by ``order`` (a unique ordering).

    Two stages so a hot group is spread: first the top ``n`` within
    ``(group, salt)``, then the top ``n`` among those survivors (at most
    ``n * salts`` rows per group).
    """
    group, order = list(group), list(order)
    sk = F.col(salt_key) if salt_key else F.xxhash64(*[F.col(o) if isinstance(o, str) else o for o in order])
    d = df.withColumn("_salt", F.pmod(sk, F.lit(salts)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    s1 = d.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n)
    w2 = Window.partitionBy(*group).orderBy(*order)
    s2 = s1.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= n)
    return s2.drop("_salt", "_r")


def auto_top_n(area: float, point_area: float) -> int:
    """``max(3, ceil(1.5 * area / point_area))``."""
    import math
    return max(3, math.ceil(1.5 * area / point_area))
