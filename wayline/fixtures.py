"""Fixture frames F1-F8, derived by expressions from the driver tables.

Each frame has a SQL twin in ``wayline.plans.oracle`` so that the DuckDB
oracle sees the very same rows.  Only integer arithmetic and division by a
double literal are used, so both engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions.scalars import epoch_micros
from wayline.sources.tables import table


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trajectory points from ``events``."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        F.col("user_id").alias("trip"),
        eid.alias("seq"),
        F.col("ts"),
        (F.lit(116.0) + (eid * 37 % 10000) / F.lit(2e4)).alias("lng"),
        (F.lit(39.6) + (eid * 91 % 10000) / F.lit(2e4)).alias("lat"),
        F.when(eid % 50 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("value") / F.lit(20.0)).alias("spd"),
        F.get_json_object("props", "$.k").cast("int").alias("acc"),
        F.when(eid % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("event_type")).alias("title"),
    )


def _fmt(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 nested form: one case per trip with its points as arrays.

    ``tjs`` is null for trip % 10 = 0 (a case without points).  The grid
    centre is the rounded mean point of the trip.
    """
    p = points(spark, sf_dir)
    grid = p.groupBy("trip").agg(
        F.round(F.avg("lng"), 4).alias("grid_lng"),
        F.round(F.avg("lat"), 4).alias("grid_lat"))
    p = p.join(grid, "trip")
    d2g = F.sqrt((F.col("lng") - F.col("grid_lng")) ** 2 +
                 (F.col("lat") - F.col("grid_lat")) ** 2) * F.lit(1e5)
    pt = F.struct("lng", "lat", "ts", "spd", "acc")
    txt = F.array(_fmt(F.col("lng"), 6), _fmt(F.col("lat"), 6),
                  epoch_micros("ts").cast("string"),
                  F.coalesce(_fmt(F.col("spd"), 4), F.lit("")),
                  _fmt(d2g, 2))
    agg = p.groupBy("trip", "grid_lng", "grid_lat").agg(
        F.min("lng").alias("rdc_lng"),
        F.min("lat").alias("rdc_lat"),
        F.min("ts").alias("enter_grid_ts"),
        F.max("ts").alias("leave_grid_ts"),
        F.count(F.lit(1)).cast("int").alias("count"),
        ((epoch_micros(F.max("ts")) - epoch_micros(F.min("ts"))) / F.lit(6e7) + F.lit(1.0)).alias("ata"),
        F.array_sort(F.collect_list(F.when(F.col("title") == "signup",
                              F.struct(F.col("seq").alias("id"),
                                       epoch_micros("ts").alias("ts"))))).alias("req"),
        F.collect_list(pt).alias("_tjs"),
        F.collect_list(txt).alias("grid_trajs"),
    )
    return agg.select(
        "trip", "rdc_lng", "rdc_lat", "grid_lng", "grid_lat", "enter_grid_ts",
        "leave_grid_ts", F.concat(F.lit("W"), F.col("trip").cast("string")).alias("waybill_code"),
        "count", "ata", "req",
        F.when(F.col("trip") % 10 == 0, F.lit(None)).otherwise(F.col("_tjs")).alias("tjs"),
        "grid_trajs")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with competing outcomes (dispatch / cancel / timeout)."""
    o = table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    st = F.col("o_orderstatus")
    return o.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("dt"),
        ok.cast("string").alias("oid"),
        F.col("o_custkey").cast("string").alias("user_id"),
        (st == "F").cast("bigint").alias("assignd"),
        (st == "O").cast("bigint").alias("canceld"),
        (st == "P").cast("bigint").alias("timeoutd"),
        F.floor(F.col("o_totalprice") / F.lit(1000.0)).cast("bigint").alias("Xt"),
        (F.col("o_custkey") % 50).cast("string").alias("sHexID"),
        (ok % 50).cast("string").alias("eHexID"),
        (ok * 7 % 48).cast("string").alias("timeSlice"),
        (F.weekday("o_orderdate") + 1).cast("string").alias("dayofweek"),
        F.array((ok % 5).cast("string"), F.lit(""), (ok % 3).cast("string"))
         .alias("reserve_partner_car_type_id"),
        (F.col("o_totalprice") / F.lit(10000.0)).alias("dist"),
        F.col("o_totalprice").alias("price"),
        ok.alias("orderkey"),
        F.col("o_orderdate").alias("ts"),
    )


def sequences_long(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    """F3 in long form: one row per line of an order with its position.

    ``pos`` is the 1-based place of the line in the order's sequence, ordered
    by (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice); the
    window is partitioned by order, so it spreads over all orders.
    """
    from pyspark.sql import Window
    li = table(spark, sf_dir, "lineitem")
    if where:
        li = li.where(where)
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    wy = Window.partitionBy("l_orderkey").orderBy(
        "l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return li.select(
        F.col("l_orderkey").alias("seq_id"),
        F.row_number().over(w).alias("pos"),
        (F.row_number().over(wy) - 1).alias("y_rank"),
        F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"),
        F.col("l_quantity"), F.col("l_extendedprice"))


def sequences(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    """one row per order with parallel arrays (the JSON-lines shape).

    ``where`` filters lineitem first (SQL text over its columns)."""
    s = sequences_long(spark, sf_dir, where)
    k = F.col("seq_id")
    pcs = F.col("l_quantity") + F.when(k % 2 == 1, F.lit(0.5)).otherwise(F.lit(0.0))
    ordered = F.array_sort(F.collect_list(F.struct(
        F.col("pos"),
        F.col("l_partkey").cast("string").alias("poi"),
        (F.col("l_partkey") % 20).cast("string").alias("g5"),
        (F.col("l_partkey") % 100).cast("string").alias("g6"),
        (F.col("l_partkey") % 500).cast("string").alias("g7"),
        pcs.alias("pcs"),
        F.col("l_linenumber").alias("rm"),
        F.col("y_rank").cast("int").alias("y"),
        F.col("l_partkey").alias("pk"))))
    g = s.groupBy("seq_id").agg(ordered.alias("_s"))
    g6 = F.col("_s.g6")
    return g.select(
        "seq_id",
        F.when(k % 97 == 0, F.lit(None).cast("string"))
         .otherwise((k % 41).cast("string")).alias("grid_station_id"),
        (k % 211).cast("string").alias("driver_code"),
        F.col("_s.poi").alias("poi_id_sequence_app"),
        F.col("_s.g5").alias("grid5_sequence_app"),
        F.when(k % 31 == 0, F.slice(g6, 1, F.size(g6) - 1)).otherwise(g6)
         .alias("grid6_sequence_app"),
        F.col("_s.g7").alias("grid7_sequence_app"),
        F.col("_s.pcs").alias("pcs_sequence_app"),
        F.col("_s.rm").alias("reach_minute_sequence_real"),
        F.col("_s.y").alias("Y"),
        F.transform(F.col("_s.pk"), lambda a: F.transform(
            F.concat(F.col("_s.pk"), F.array(F.lit(0).cast("bigint"))),
            lambda b: F.abs(a - b).cast("double"))).alias("earth_dist"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """binary label and a score in [0, 1] with many ties."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.lit(0.05) + F.col("l_discount") + F.col("l_tax")).alias("score"))


def two_samples(spark: SparkSession, sf_dir: str, drop_category: str | None = None) -> DataFrame:
    """side 0 = even user_id, side 1 = odd; key = event_type; critic score value/500."""
    e = table(spark, sf_dir, "events")
    df = e.select((F.col("user_id") % 2).cast("int").alias("side"),
                  F.col("event_type").alias("key"),
                  (F.col("value") / F.lit(500.0)).alias("score"))
    if drop_category is not None:
        df = df.where(~((F.col("side") == 1) & (F.col("key") == drop_category)))
    return df


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M(i, j, v) = sum(l_quantity) by (l_orderkey % 100, l_suppkey)."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy((F.col("l_orderkey") % 100).alias("i"), F.col("l_suppkey").alias("j"))
              .agg(F.sum("l_quantity").alias("v")))


def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 vector (j, v) = supplier account balance."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("j"), F.col("s_acctbal").alias("v"))
