"""Distance-bounded neighbour statistics as a bucketed range join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions.geo import EARTH_RADIUS_M
from wayline.operators.ordered import written

# Fixed values
METRES_PER_DEG_LAT_MIN = 110_000.0   # lower bound of the length of one degree of latitude


# Pairs compared at a time: (left places, right places) of a block, which stays in a processor's cache
BLOCK = (64, 512)


def _compared(a_max: float, r_m: float, box: tuple[float, float, bool] | None):
    """Task over (cell, part, side, place, weight) rows, sorted so that a part's left places come first.

    Left places of one part are held; the right ones pass by in batches, and
    number, least and total distance of each left place are added up.
    """
    radius = 2 * EARTH_RADIUS_M

    def unit(lng: np.ndarray, lat: np.ndarray) -> np.ndarray:
        p, l = np.radians(lat), np.radians(lng)  # noqa: E741
        return np.stack([np.cos(p) * np.cos(l), np.cos(p) * np.sin(l), np.sin(p)]) / 2   # half the chord: a = |u - v|^2

    def add(held: dict, lng: np.ndarray, lat: np.ndarray, weight: np.ndarray) -> None:
        v = unit(lng, lat)
        for i in range(0, len(held["lng"]), BLOCK[0]):
            mine = slice(i, i + BLOCK[0])
            u = held["unit"][:, mine, None]
            for j in range(0, len(lng), BLOCK[1]):
                his = slice(j, j + BLOCK[1])
                a = (u[0] - v[0][his]) ** 2
                a += (u[1] - v[1][his]) ** 2
                a += (u[2] - v[2][his]) ** 2
                if box:
                    dx, dy = held["lng"][mine, None] - lng[his], np.abs(held["lat"][mine, None] - lat[his])
                    off = (np.abs(dx) > box[0]) | (dy > box[1])
                    if box[2]:   # a whole circle of latitude: each point once, on its shorter side
                        off |= (dx >= 180) | (dx < -180)
                    a[off] = np.inf
                hit = (a <= a_max).astype(np.float64)
                np.minimum(a, 1.0, out=a)
                s = np.sqrt(a)
                if a_max < 1e-4:   # the series of asin, to the last digit here
                    s *= 1 + a * (1 / 6 + a * (3 / 40 + a * (15 / 336)))
                else:
                    s = np.arcsin(s)
                s *= radius
                if box or a_max >= 1e-4 or s.max(initial=0.0) > r_m:
                    hit *= s <= r_m
                held["n"][mine] += hit @ weight[his]
                held["least"][mine] = np.minimum(held["least"][mine], np.where(hit > 0, s, np.inf).min(axis=1))
                s *= hit
                held["sum"][mine] += s @ weight[his]

    def result(held: dict) -> Iterator[pa.RecordBatch]:
        ok = held["n"] > 0
        if ok.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(held["lng"][ok]), pa.array(held["lat"][ok]), pa.array(held["n"][ok].astype(np.int64)),
                 pa.array(held["least"][ok]), pa.array(held["sum"][ok])], names=["_lng", "_lat", "_n", "_min", "_sum"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lefts, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cx, cy, part, side, lng, lat, weight = (batch.column(i).to_numpy() for i in range(7))
            ends = np.flatnonzero((np.diff(cx) != 0) | (np.diff(cy) != 0) | (np.diff(part) != 0)) + 1
            for i, j in zip([0, *ends], [*ends, len(cx)]):
                if (cx[i], cy[i], part[i]) != at:
                    if held:
                        yield from result(held)
                    at, lefts, held = (cx[i], cy[i], part[i]), [], None
                m = i + int(np.searchsorted(side[i:j], 1))
                if m > i:
                    lefts.append((lng[i:m], lat[i:m]))
                if m < j and lefts:
                    if not held:
                        x, y = (np.concatenate(c) for c in zip(*lefts))
                        held = {"lng": x, "lat": y, "unit": unit(x, y), "n": np.zeros(len(x)), "sum": np.zeros(len(x)),
                                "least": np.full(len(x), np.inf)}
                    add(held, lng[m:j], lat[m:j], weight[m:j].astype(np.float64))
        if held:
            yield from result(held)

    return run


def nearby_stats(left: DataFrame, right: DataFrame, r_m: float, key: str = "oid",
                 lng: str = "lng", lat: str = "lat", cells_per_radius: int = 2,
                 cell_rows: int = 4096) -> DataFrame:
    """For each left point: number, nearest and mean distance of right points within ``r_m``.

    Both sides are cut into grid cells ``r_m / k`` wide (``k`` =
    ``cells_per_radius``; the longitude width uses the largest |latitude| in
    the data, one aggregate).  The right side is copied into the
    ``(2k+1) x (2k+1)`` neighbourhood and joined on the cell, so only pairs
    in nearby cells are compared - never all pairs.  Finer cells (larger k)
    compare fewer pairs (area ``((2k+1)/k)^2 r^2`` against ``pi r^2``) at the
    cost of more copies of the right side.

    Left places are counted per cell; a cell of more than ``cell_rows`` is dealt
    into parts of about that many, and the right places of its neighbourhood are
    copied to each, so a hot cell is spread over tasks.

    Equal places are compared once, right ones with their number as a weight.  A
    task holds the left places of one part and reads the right ones in batches; no
    pair becomes a row.  The pairs within ``r_m`` themselves are all compared, so
    the work still grows with the square of the density of different places.
    """
    mx = left.select(F.max(F.abs(lat)).alias("m")).union(right.select(F.max(F.abs(lat)).alias("m"))) \
        .agg(F.max("m")).first()[0]
    mx = min(float(mx or 0.0) + 0.5, 89.0)
    k = max(1, int(cells_per_radius))
    dlat = r_m / METRES_PER_DEG_LAT_MIN
    dlng = dlat / math.cos(math.radians(mx))
    clat, clng = dlat / k, dlng / k
    x, y = F.col(lng).cast("double"), F.col(lat).cast("double")
    lc = left.select(x.alias("_lng"), y.alias("_lat")).where("_lng is not null and _lat is not null").distinct().withColumns({
        "_cx": F.floor(F.col("_lng") / F.lit(clng)).cast("bigint"), "_cy": F.floor(F.col("_lat") / F.lit(clat)).cast("bigint")})
    rng = range(-k, k + 1)
    offs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in rng for b in rng
                     if (max(abs(a) - 1, 0) * clat) ** 2 + (max(abs(b) - 1, 0) * clat) ** 2 <= dlat ** 2])
    # a point close to the 180th meridian also lies 360 degrees to its other side
    turns = F.array_compact(F.array(F.lit(0.0), F.when(F.col("_lng") > F.lit(180 - dlng), F.lit(-360.0)),
                                    F.when(F.col("_lng") < F.lit(dlng - 180), F.lit(360.0))))
    rc = right.select(x.alias("_lng"), y.alias("_lat")).where("_lng is not null and _lat is not null").groupBy("_lng", "_lat").agg(
        F.count(F.lit(1)).alias("_w"))
    rc = rc.select("_lng", "_lat", "_w", F.explode(turns).alias("_turn")).select(
        (F.col("_lng") + F.col("_turn")).alias("_lng"), "_lat", "_w").select(
        "*", F.floor(F.col("_lng") / F.lit(clng)).cast("bigint").alias("_rx"),
        F.floor(F.col("_lat") / F.lit(clat)).cast("bigint").alias("_ry"), F.explode(offs).alias("_o")).select(
        "_lng", "_lat", "_w", (F.col("_rx") + F.col("_o.a")).alias("_cx"), (F.col("_ry") + F.col("_o.b")).alias("_cy"))
    # haversine term a = sin^2(dphi/2) + cos1 cos2 sin^2(dlambda/2), the square of half the chord; d <= r  <=>  a <= sin^2(r / 2R)
    a_max = math.sin(r_m / (2 * EARTH_RADIUS_M)) ** 2 * (1 + 1e-12)
    # places within r lie in the box of dlng and dlat anyway, but for the poles and for cells that reach round the earth
    box = (dlng, dlat, dlng >= 180) if mx >= 89 or dlng > 60 else None
    # written, so the planner knows its size: the copies of the right side are shuffled once more only if it is large
    hot = written(lc.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > cell_rows)
                  .select("_cx", "_cy", F.ceil(F.col("_c") / F.lit(cell_rows)).cast("int").alias("_parts")), "hot-cells")
    parts = F.coalesce("_parts", F.lit(1))
    lc = lc.join(hot, ["_cx", "_cy"], "left").withColumn("_part", F.pmod(F.xxhash64("_lng", "_lat"), parts).cast("int"))
    rc = rc.join(hot, ["_cx", "_cy"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    both = lc.select("_cx", "_cy", "_part", F.lit(0).alias("_side"), "_lng", "_lat", F.lit(0).cast("bigint").alias("_w")).union(
        rc.select("_cx", "_cy", "_part", F.lit(1).alias("_side"), "_lng", "_lat", "_w"))
    # a fixed number of partitions: the work is in the pairs, so AQE, which measures bytes, would
    # merge them into a few tasks; hot cells are dealt into parts above, so none needs splitting
    both = both.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_cx", "_cy", "_part")
    found = both.sortWithinPartitions("_cx", "_cy", "_part", "_side").mapInArrow(
        _compared(a_max, r_m, box), "_lng double, _lat double, _n bigint, _min double, _sum double")
    agg = left.select(key, x.alias("_lng"), y.alias("_lat")).join(found, ["_lng", "_lat"]).groupBy(key).agg(
        F.sum("_n").alias("n_cars"), F.min("_min").alias("min_dist"), (F.sum("_sum") / F.sum("_n")).alias("avg_dist"))
    return left.select(key).join(agg, key, "left").select(
        key, F.coalesce("n_cars", F.lit(0)).alias("n_cars"), "min_dist", "avg_dist")
