"""Compressed point paths in chunks of bounded point count, each decoded by itself.

Format (per point, in path order): coordinates x 1e5 rounded; delta to the
previous point (the first from 0, 0); zigzag of both deltas; the pair joined
as ``(x + y)(x + y + 1) / 2 + x`` with x the latitude delta; the number
written in base-32 digits, low digit first, every digit but the last
carrying +32, each digit one character of the table below.  A zero number
writes nothing, so a repeated point disappears.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.ordered import numbered

# Fixed values
CODE_TABLE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
PRECISION = 100000
MAX_DIGITS = 13

#: Points of a chunk.
CHUNK_POINTS = 4096


def _shr(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n)


def _shl(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n)


def zigzag(d: Column) -> Column:
    return F.shiftleft(d, 1).bitwiseXOR(F.shiftright(d, 31))


def unzigzag(n: Column) -> Column:
    return F.when(n % 2 == 0, F.floor(n / 2)).otherwise(-F.floor((n + 1) / 2)).cast("bigint")


def pair_index(x: Column, y: Column) -> Column:
    s = x + y
    return (s * (s + 1) / 2).cast("bigint") + x


def digits_text(idx: Column) -> Column:
    """Base-32 digits of ``idx``, low first, continuation +32 on all but the last.

    At most ``MAX_DIGITS`` digits, so the loop is unrolled into scalar
    expressions (compiled by whole-stage code generation).
    """
    parts = []
    for k in range(MAX_DIGITS):
        here = F.shiftright(idx, 5 * k)
        more = F.shiftright(idx, 5 * (k + 1)) > 0
        pos = here.bitwiseAND(F.lit(31)) + F.when(more, F.lit(32)).otherwise(F.lit(0)) + 1
        parts.append(F.when(here > 0, F.substring(F.lit(CODE_TABLE), pos.cast("int"), 1)).otherwise(F.lit("")))
    return F.concat(*parts)


def _chunked(points: DataFrame, trip: str, order: list[str], size: int) -> DataFrame:
    """Points with their place ``pos`` in the trip, their chunk of ``size`` points and the
    whole-number coordinates of the point before (``pa``, ``po``; null for a trip's first).

    The last point of a chunk is copied into the next one, so each chunk knows
    where it starts and nothing is joined.
    """
    q = points.select(trip, *order, F.round(F.col("lat") * F.lit(float(PRECISION))).cast("bigint").alias("ilat"),
                      F.round(F.col("lng") * F.lit(float(PRECISION))).cast("bigint").alias("ilng"))
    n = numbered(q, order, [trip], "pos")
    own = F.floor((F.col("pos") - 1) / F.lit(size)).cast("bigint")
    c = n.select("*", F.explode(F.when(F.col("pos") % size == 0, F.array(own, own + 1)).otherwise(F.array(own))).alias("chunk"), own.alias("_own"))
    w = Window.partitionBy(trip, "chunk").orderBy("pos")
    return c.select("*", F.lag("ilat").over(w).alias("pa"), F.lag("ilng").over(w).alias("po")).where(F.col("_own") == F.col("chunk")).drop("_own")


def _with_codes(chunked: DataFrame) -> DataFrame:
    dx = F.col("ilat") - F.coalesce("pa", F.lit(0))
    dy = F.col("ilng") - F.coalesce("po", F.lit(0))
    return chunked.withColumn("index", pair_index(zigzag(dx), zigzag(dy))).withColumn("code", digits_text(F.col("index")))


def encode_points(points: DataFrame, trip: str = "trip", order=("ts", "seq"), size: int = CHUNK_POINTS) -> DataFrame:
    """Per point: its code piece ``(trip, order..., code)``; concatenated in order they
    form the trip's text.  A long trip is spread over its chunks."""
    order = list(order)
    return _with_codes(_chunked(points, trip, order, size)).select(trip, *order, "ilat", "ilng", "index", "code")


def encode_chunks(points: DataFrame, trip: str = "trip", order=("ts", "seq"), size: int = CHUNK_POINTS) -> DataFrame:
    """``(trip, chunk, start_lat, start_lng, n, text)``: each trip cut into chunks of ``size`` points.

    A chunk is decoded without the others: ``start_*`` is the point before its first
    one, in whole 1e-5 degrees (0, 0 at the start of a trip).  The texts of a trip's
    chunks, joined in order, are the trip's whole text.
    """
    e = _with_codes(_chunked(points, trip, list(order), size))
    g = e.groupBy(trip, "chunk").agg(
        F.min_by(F.struct("pa", "po"), "pos").alias("_s"), F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda s: s["code"]), "").alias("text"))
    return g.select(trip, "chunk", F.coalesce("_s.pa", F.lit(0)).alias("start_lat"), F.coalesce("_s.po", F.lit(0)).alias("start_lng"), "n", "text")


def encode_polylines(points: DataFrame, trip: str = "trip", order=("ts", "seq"), size: int = CHUNK_POINTS) -> DataFrame:
    """Per trip: the full text, the texts of its chunks joined (one value a trip, as the format has it)."""
    return encode_chunks(points, trip, order, size).groupBy(trip).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda s: s["text"]), "").alias("text"))


def unpair(e: Column) -> tuple[Column, Column]:
    """Inverse of ``pair_index``: (x, y), with a +-1 correction of the float square root."""
    w0 = F.floor((F.sqrt(e.cast("double") * 8 + 1) - 1) / 2).cast("bigint")
    t = lambda w: (w * (w + 1) / 2).cast("bigint")
    w1 = F.when(t(w0) > e, w0 - 1).otherwise(w0)
    w = F.when(t(w1 + 1) <= e, w1 + 1).otherwise(w1)
    x = e - t(w)
    return x, w - x


def _decoded(df: DataFrame, key: list[str], text: str, start: tuple[Column, Column]) -> DataFrame:
    """``(key..., k, lat, lng)`` of each text, k from 1, its deltas added to ``start``.

    Relational decoding, no array lambdas: characters are exploded with
    their position; running window functions give each character its
    number (terminal characters before it) and its digit place (distance to
    the last terminal before it); a group-by sums the digits of each number;
    a running window turns deltas into coordinates.  Every step is
    partitioned by the text's key (one exchange).
    """
    chars = df.select(*key, start[0].alias("_a"), start[1].alias("_o"), F.posexplode(F.split(F.col(text), "")).alias("pos", "c")).where(F.col("c") != "")
    v = F.instr(F.lit(CODE_TABLE), F.col("c")) - 1
    before = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    x = chars.select(*key, "_a", "_o", "pos", v.alias("v"))
    term = F.col("v") < 32
    x = x.select(*key, "_a", "_o", "pos", "v",
                 F.coalesce(F.sum(term.cast("int")).over(before), F.lit(0)).alias("num"),
                 F.coalesce(F.max(F.when(term, F.col("pos"))).over(before), F.lit(-1)).alias("last_t"))
    place = (F.col("pos") - F.col("last_t") - 1).cast("int")
    digit = (F.col("v") - F.when(term, F.lit(0)).otherwise(F.lit(32))).cast("bigint")
    nums = x.groupBy(*key, "num").agg(F.sum(_shl(digit, place * 5)).alias("_e"), F.first("_a").alias("_a"), F.first("_o").alias("_o"))
    xx, yy = unpair(F.col("_e"))
    d = nums.select(*key, "_a", "_o", (F.col("num") + 1).cast("bigint").alias("k"), unzigzag(xx).alias("dlat"), unzigzag(yy).alias("dlng"))
    w = Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.select(*key, "k", ((F.col("_a") + F.sum("dlat").over(w)) / F.lit(float(PRECISION))).alias("lat"),
                    ((F.col("_o") + F.sum("dlng").over(w)) / F.lit(float(PRECISION))).alias("lng"))


def decode_polylines(df: DataFrame, trip: str = "trip", text: str = "text") -> DataFrame:
    """``(trip, k, lat, lng)`` in path order, k from 1.  A trip's whole text is one value and is
    decoded by one task; ``decode_chunks`` spreads a trip."""
    return _decoded(df, [trip], text, (F.lit(0), F.lit(0)))


def decode_chunks(df: DataFrame, trip: str = "trip") -> DataFrame:
    """``(trip, chunk, k, lat, lng)`` of ``encode_chunks``, k from 1 in each chunk; chunks are decoded apart."""
    return _decoded(df, [trip, "chunk"], "text", (F.col("start_lat"), F.col("start_lng")))
