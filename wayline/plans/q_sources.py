"""Registered queries: sources and sinks as write / read round trips (#1, #4-17).

Each query writes into a fresh folder under the shared checkpoint folder
(``spark.checkpoint.dir``) and returns the frame read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline import fixtures as fx
from wayline.operators import vocab as vc
from wayline.plans.oracle_fixtures import OUTCOMES, POINTS, seq_long
from wayline.plans.q_geo import SQL_HEX_LAYER
from wayline.plans.q_vocab import MISS_FIELDS, SQL_BUILD_VOCAB, SQL_SPLIT_BY_COVERAGE, SQL_VALUE_COUNTS, TEST, \
    train_vocab
from wayline.session import scratch_path
from wayline.sources import readers as rd
from wayline.sources import writers as wr


def _dir(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


MONTH = "1997-05"


def q_scan_partition(spark, sf):
    """#17 writes outcomes partitioned by month (dynamic overwrite); #1 scans one partition."""
    path = _dir(spark, "outcomes")
    o = fx.outcomes(spark, sf).drop("reserve_partner_car_type_id").withColumn("month", F.substring("dt", 1, 7))
    wr.write_partitions(o, path, ["month"])
    # a second write of one partition replaces only that partition
    wr.write_partitions(o.where(F.col("month") == MONTH), path, ["month"])
    df = rd.scan_partition(spark, None, MONTH, n=None, partition_col="month", path=path)
    return df.select(F.col("month").cast("string").alias("month"), "dt", "oid", "user_id", "Xt", "dist")


SQL_SCAN_PARTITION = f"""
WITH f AS ({OUTCOMES})
SELECT substr(dt, 1, 7) AS month, dt, oid, user_id, Xt, dist FROM f WHERE substr(dt, 1, 7) = '{MONTH}'
"""

DEFAULTS_SCHEMA = T.StructType([
    T.StructField("oid", T.StringType()), T.StructField("Xt", T.LongType()),
    T.StructField("ord_num", T.DoubleType()), T.StructField("null_ord_num", T.LongType()),
    T.StructField("online_cnt5min", T.DoubleType()), T.StructField("null_online_cnt5min", T.LongType()),
    T.StructField("reserve_partner_car_type_id", T.ArrayType(T.StringType())),
])


def q_scan_with_defaults(spark, sf):
    """Records with absent values read with declared defaults (user indicator 1, others 0)."""
    path = _dir(spark, "records")
    o = fx.outcomes(spark, sf)
    k = F.col("orderkey")
    rec = o.select("oid", F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("Xt")).alias("Xt"),
                   F.when(k % 7 == 0, F.lit(None)).otherwise(F.lit(1.0)).alias("ord_num"),
                   F.when(k % 7 == 0, F.lit(None)).otherwise(F.lit(0).cast("bigint")).alias("null_ord_num"),
                   F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("dist")).alias("online_cnt5min"),
                   F.when(k % 5 == 0, F.lit(None)).otherwise(F.lit(0).cast("bigint")).alias("null_online_cnt5min"),
                   F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("reserve_partner_car_type_id"))
                    .alias("reserve_partner_car_type_id"))
    rec.write.parquet(path)
    df = rd.scan_with_defaults(spark, path, DEFAULTS_SCHEMA, {
        "oid": rd.Required, "Xt": 0, "ord_num": 0.0, "null_ord_num": 1, "online_cnt5min": 0.0,
        "null_online_cnt5min": 0, "reserve_partner_car_type_id": []})
    return df.select("oid", "Xt", "ord_num", "null_ord_num", F.round("online_cnt5min", 6).alias("online_cnt5min"),
                     "null_online_cnt5min", F.size("reserve_partner_car_type_id").alias("n_types"))


SQL_SCAN_WITH_DEFAULTS = f"""
WITH f AS ({OUTCOMES})
SELECT oid, CASE WHEN orderkey % 13 = 0 THEN 0 ELSE Xt END AS Xt,
       CASE WHEN orderkey % 7 = 0 THEN 0e0 ELSE 1e0 END AS ord_num,
       CAST(CASE WHEN orderkey % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS null_ord_num,
       round(CASE WHEN orderkey % 5 = 0 THEN 0e0 ELSE dist END, 6) AS online_cnt5min,
       CAST(0 AS BIGINT) AS null_online_cnt5min,
       CASE WHEN orderkey % 11 = 0 THEN 0 ELSE 3 END AS n_types
FROM f
"""

SEQ_SCHEMA = T.StructType([
    T.StructField("seq_id", T.LongType()), T.StructField("grid_station_id", T.StringType()),
    T.StructField("driver_code", T.StringType()),
    T.StructField("poi_id_sequence_app", T.ArrayType(T.StringType())),
    T.StructField("pcs_sequence_app", T.ArrayType(T.DoubleType())),
    T.StructField("Y", T.ArrayType(T.IntegerType())),
])


def q_scan_json_lines(spark, sf):
    """F3 as JSON lines, read back with an explicit schema in FAILFAST mode (#5), line count (#6)."""
    path = _dir(spark, "seq-json")
    fx.sequences(spark, sf).select(*[f.name for f in SEQ_SCHEMA.fields]).write.json(path)
    df = rd.scan_json_lines(spark, path, SEQ_SCHEMA)
    n_lines = rd.count_lines(spark, path)
    return df.select("seq_id", "grid_station_id", "driver_code", F.size("poi_id_sequence_app").alias("n"),
                     F.element_at("poi_id_sequence_app", 1).alias("first_poi"),
                     F.round(F.aggregate("pcs_sequence_app", F.lit(0.0), lambda a, x: a + x), 4).alias("pcs_sum"),
                     F.lit(n_lines).cast("bigint").alias("n_lines"))


SQL_SCAN_JSON_LINES = f"""
WITH sl AS ({seq_long()}), n AS (SELECT count(DISTINCT seq_id) AS n_lines FROM sl)
SELECT seq_id, CASE WHEN seq_id % 97 = 0 THEN NULL ELSE CAST(seq_id % 41 AS VARCHAR) END AS grid_station_id,
       CAST(seq_id % 211 AS VARCHAR) AS driver_code, CAST(count(*) AS INTEGER) AS n,
       CAST(max(CASE WHEN pos = 1 THEN l_partkey END) AS VARCHAR) AS first_poi,
       round(sum(l_quantity + CASE WHEN seq_id % 2 = 1 THEN 0.5e0 ELSE 0e0 END), 4) AS pcs_sum,
       max(n.n_lines) AS n_lines
FROM sl, n GROUP BY seq_id
"""


def q_scan_svmlight(spark, sf):
    """Zero-based sparse rows written as text and parsed back (#7)."""
    path = _dir(spark, "svm")
    from wayline.sources.tables import table
    t = table(spark, sf, "lineitem")
    line = F.concat_ws(" ", (F.col("l_returnflag") == "R").cast("int").cast("string"),
                       F.concat(F.lit("0:"), F.col("l_quantity").cast("string")),
                       F.concat(F.lit("1:"), F.col("l_discount").cast("string")),
                       F.concat(F.lit("3:"), F.col("l_linenumber").cast("string")))
    t.select(line.alias("value")).write.text(path)
    df = rd.scan_svmlight(spark, path)
    return df.select("label", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"),
                     F.col("features")[3].alias("f3"), F.size("features").alias("nnz"))


SQL_SCAN_SVMLIGHT = """
SELECT CAST(l_returnflag = 'R' AS DOUBLE) AS label, l_quantity AS f0, l_discount AS f1,
       CAST(l_linenumber AS DOUBLE) AS f3, 3 AS nnz FROM lineitem
"""


def q_scan_points_csv(spark, sf):
    """Points written as ``lng,lat[,title]`` lines (blank line every 100th) and read back (#8)."""
    path = _dir(spark, "points-csv")
    p = fx.points(spark, sf)
    line = F.when(F.col("seq") % 100 == 0, F.lit("")).otherwise(
        F.concat_ws(",", F.format_string("%.5f", "lng"), F.format_string("%.5f", "lat"), F.col("title")))
    p.orderBy("seq").select(line.alias("value")).write.text(path)  # many files, in order of their names
    return rd.scan_points_csv(spark, path)


SQL_SCAN_POINTS_CSV = f"""
WITH points AS ({POINTS}),
o AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS ordinal FROM points)
SELECT ordinal, CASE WHEN seq % 100 = 0 THEN NULL ELSE CAST(printf('%.5f', lng) AS DOUBLE) END AS lng,
       CASE WHEN seq % 100 = 0 THEN NULL ELSE CAST(printf('%.5f', lat) AS DOUBLE) END AS lat,
       CASE WHEN seq % 100 <> 0 AND title IS NOT NULL THEN title ELSE CAST(ordinal AS VARCHAR) END AS title
FROM o
"""

CASE_SCHEMA = T.StructType([
    T.StructField("trip", T.LongType()), T.StructField("waybill_code", T.StringType()),
    T.StructField("count", T.IntegerType()),
    T.StructField("tjs", T.ArrayType(T.StructType([
        T.StructField("lng", T.DoubleType()), T.StructField("lat", T.DoubleType()),
        T.StructField("ts", T.TimestampNTZType()), T.StructField("spd", T.DoubleType()),
        T.StructField("acc", T.IntegerType())]))),
])


def q_scan_cases_json(spark, sf):
    """Cases written as JSON arrays, one per partition, and read back by line as nested rows (#9)."""
    path = _dir(spark, "cases-json")
    wr.write_json_arrays(fx.cases(spark, sf).select("trip", "waybill_code", "count", "tjs"), path)
    c = rd.scan_json_arrays(spark, path, CASE_SCHEMA)
    return c.select("trip", "waybill_code", "count", F.size("tjs").alias("n_points"))


SQL_SCAN_CASES_JSON = f"""
WITH points AS ({POINTS})
SELECT trip, 'W' || trip AS waybill_code, CAST(count(*) AS INTEGER) AS count,
       CAST(CASE WHEN trip % 10 = 0 THEN NULL ELSE count(*) END AS INTEGER) AS n_points
FROM points GROUP BY trip
"""


def q_scan_hex_json(spark, sf):
    """The hex layer written as JSON arrays (plus an empty-id record) and read back by line (#10)."""
    from wayline.operators.geo import hex_layer
    path = _dir(spark, "hex-json")
    layer = hex_layer(fx.points(spark, sf), 1000.0).select("HexID", "center", "polygeo", "color", "desc")
    bad = layer.limit(1).select(F.lit("").alias("HexID"), "center", "polygeo", "color", "desc")
    wr.write_json_arrays(layer.union(bad), path)
    h = rd.scan_hex_json(spark, path, by_line=True)
    return h.select("HexID", "color", F.element_at("desc", 1).alias("desc"))


def q_vocab_round_trip(spark, sf):
    """Vocabularies written one folder per field and one field read back (#11)."""
    path = _dir(spark, "vocab")
    wr.write_vocab(train_vocab(spark, sf), path)
    return wr.read_vocab(spark, path, "poi")


SQL_VOCAB_ROUND_TRIP = SQL_BUILD_VOCAB.replace("SELECT field, token, id FROM vocab",
                                               "SELECT field, token, id FROM vocab WHERE field = 'poi'")


def q_value_counts_csv(spark, sf):
    """Frequency list written as headerless CSV, most frequent first, and read back (#12)."""
    path = _dir(spark, "counts")
    s = fx.sequences(spark, sf).where(F.col("grid_station_id").isNotNull())
    wr.write_value_counts(vc.value_counts(s, "poi_id_sequence_app"), path)
    return spark.read.schema("token string, n bigint").csv(path)


def q_write_split(spark, sf):
    """Rows routed to part 0 / part 1 by vocabulary coverage and read back (#13)."""
    path = _dir(spark, "split")
    test = fx.sequences(spark, sf, TEST)
    s = vc.split_by_coverage(test, train_vocab(spark, sf), MISS_FIELDS, key="seq_id")
    wr.write_split(s.select("seq_id", "part"), path, "part")
    return spark.read.schema("seq_id bigint").json(path).select("seq_id", F.col("part").cast("int").alias("part"))


def q_write_records_json(spark, sf):
    """The first 1,000 scored rows (by order key) as JSON records (#14)."""
    from wayline.plans.q_scoring import with_params
    from wayline.operators.scoring import competing_risk_rows
    path = _dir(spark, "records-json")
    s = competing_risk_rows(with_params(fx.outcomes(spark, sf))).select("orderkey", "oid", "Xt", "nll")
    wr.write_records_json(s, path, [F.col("orderkey")], 1000)
    return spark.read.schema("orderkey bigint, oid string, Xt bigint, nll double").json(path) \
        .select("orderkey", "oid", "Xt", F.round("nll", 6).alias("nll"))


def q_write_headerless(spark, sf):
    """Scored columns side by side without header (#15)."""
    path = _dir(spark, "headerless")
    o = fx.outcomes(spark, sf).select("oid", "Xt", "assignd", "canceld", "timeoutd")
    wr.write_headerless(o, path)
    return spark.read.schema("oid string, Xt bigint, assignd bigint, canceld bigint, timeoutd bigint").csv(path)


SQL_WRITE_HEADERLESS = f"WITH f AS ({OUTCOMES}) SELECT oid, Xt, assignd, canceld, timeoutd FROM f"


def q_write_name_value(spark, sf):
    """The first 2 rows as ``name \\t value`` lines (#16)."""
    path = _dir(spark, "name-value")
    o = fx.outcomes(spark, sf).select("orderkey", "dt", "oid", "user_id", "assignd", "Xt")
    wr.write_name_value(o, path, 2, [F.col("orderkey")])
    t = spark.read.text(path)
    parts = F.split("value", "\t")
    return t.select(F.element_at(parts, 1).alias("name"), F.element_at(parts, 2).alias("value"))


SQL_WRITE_NAME_VALUE = f"""
WITH f AS (SELECT * FROM ({OUTCOMES}) ORDER BY orderkey LIMIT 2)
SELECT 'orderkey' AS name, CAST(orderkey AS VARCHAR) AS value FROM f
UNION ALL SELECT 'dt', dt FROM f UNION ALL SELECT 'oid', oid FROM f UNION ALL SELECT 'user_id', user_id FROM f
UNION ALL SELECT 'assignd', CAST(assignd AS VARCHAR) FROM f UNION ALL SELECT 'Xt', CAST(Xt AS VARCHAR) FROM f
"""

def _records_sql():
    from wayline.plans.q_scoring import PARAMS_SQL, _nll_sql
    return (f"WITH {PARAMS_SQL}\nSELECT orderkey, oid, Xt, round({_nll_sql()}, 6) AS nll FROM p "
            "ORDER BY orderkey LIMIT 1000")


QUERIES = {
    "scan_partition": (q_scan_partition, SQL_SCAN_PARTITION),
    "scan_with_defaults": (q_scan_with_defaults, SQL_SCAN_WITH_DEFAULTS),
    "scan_json_lines": (q_scan_json_lines, SQL_SCAN_JSON_LINES),
    "scan_svmlight": (q_scan_svmlight, SQL_SCAN_SVMLIGHT),
    "scan_points_csv": (q_scan_points_csv, SQL_SCAN_POINTS_CSV),
    "scan_cases_json": (q_scan_cases_json, SQL_SCAN_CASES_JSON),
    "scan_hex_json": (q_scan_hex_json, f"SELECT HexID, color, \"desc\" FROM ({SQL_HEX_LAYER})"),
    "vocab_round_trip": (q_vocab_round_trip, SQL_VOCAB_ROUND_TRIP),
    "value_counts_csv": (q_value_counts_csv, SQL_VALUE_COUNTS),
    "write_split": (q_write_split, SQL_SPLIT_BY_COVERAGE),
    "write_records_json": (q_write_records_json, _records_sql()),
    "write_headerless": (q_write_headerless, SQL_WRITE_HEADERLESS),
    "write_name_value": (q_write_name_value, SQL_WRITE_NAME_VALUE),
}
