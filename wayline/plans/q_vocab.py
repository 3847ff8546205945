"""Registered queries: vocabularies, encodings, audits and padding (F3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline import fixtures as fx
from wayline.functions import sequence as sq
from wayline.operators import sequence as so
from wayline.operators import vocab as vc
from wayline.operators.ordered import numbered
from wayline.plans.oracle_fixtures import seq_long
from wayline.sources.tables import table

# The F3 train / test rules
TRAIN = "l_orderkey % 5 <> 0 AND l_orderkey % 41 < 37 AND l_partkey % 20 <> 19"
TEST = "l_orderkey % 5 = 0"
FIELDS = {"poi": "poi_id_sequence_app", "dept": "grid_station_id", "grid5": "grid5_sequence_app",
          "grid6": "grid6_sequence_app", "grid7": "grid7_sequence_app", "driver": "driver_code"}
MISS_FIELDS = {"dept": "grid_station_id", "poi": "poi_id_sequence_app",
               "grid5": "grid5_sequence_app", "grid6": "grid6_sequence_app"}


def train_vocab(spark, sf):
    train = fx.sequences(spark, sf, TRAIN)
    return vc.build_vocab(train, FIELDS, require="grid_station_id")


def q_build_vocab(spark, sf):
    return train_vocab(spark, sf)


def _tokens_sql(where: str, drop_station_null: bool) -> str:
    st = "AND seq_id % 97 <> 0" if drop_station_null else ""
    return f"""
  sl AS ({seq_long(where)}),
  tok AS (
    SELECT 'poi' AS field, CAST(l_partkey AS VARCHAR) AS token, seq_id, pos FROM sl WHERE TRUE {st}
    UNION ALL SELECT 'grid5', CAST(l_partkey % 20 AS VARCHAR), seq_id, pos FROM sl WHERE TRUE {st}
    UNION ALL SELECT 'grid6', CAST(l_partkey % 100 AS VARCHAR), seq_id, pos FROM sl
              WHERE NOT (seq_id % 31 = 0 AND pos = len) {st}
    UNION ALL SELECT 'grid7', CAST(l_partkey % 500 AS VARCHAR), seq_id, pos FROM sl WHERE TRUE {st}
    UNION ALL SELECT DISTINCT 'dept', CASE WHEN seq_id % 97 = 0 THEN NULL ELSE CAST(seq_id % 41 AS VARCHAR) END,
              seq_id, 1 FROM sl WHERE TRUE {st}
    UNION ALL SELECT DISTINCT 'driver', CAST(seq_id % 211 AS VARCHAR), seq_id, 1 FROM sl WHERE TRUE {st})"""


VOCAB_SQL = f"""
  {_tokens_sql(TRAIN, True)},
  vocab AS (
    SELECT field, token, CAST(row_number() OVER (PARTITION BY field ORDER BY CASE WHEN token = 'Non' THEN 0 ELSE 1 END,
                                                 token) AS INTEGER) AS id
    FROM (SELECT DISTINCT field, token FROM tok
          UNION SELECT f, 'Non' FROM (VALUES ('poi'), ('dept'), ('grid5'), ('grid6'), ('grid7'), ('driver')) v(f)))"""

SQL_BUILD_VOCAB = f"WITH {VOCAB_SQL}\nSELECT field, token, id FROM vocab"


def q_encode_tokens(spark, sf):
    vocab = train_vocab(spark, sf)
    test = fx.sequences(spark, sf, TEST).select("seq_id", *FIELDS.values())
    spec = {"poi_ids": ("poi", "poi_id_sequence_app"), "g5_ids": ("grid5", "grid5_sequence_app"),
            "g6_ids": ("grid6", "grid6_sequence_app"), "g7_ids": ("grid7", "grid7_sequence_app"),
            "dept_id": ("dept", "grid_station_id"), "driver_id": ("driver", "driver_code")}
    enc = vc.encode_tokens(test, vocab, spec, key="seq_id", miss_id=1)
    z = enc.select("seq_id", "dept_id", "driver_id",
                   F.posexplode(F.arrays_zip("poi_ids", "g5_ids", "g6_ids", "g7_ids")).alias("p", "z"))
    return z.select("seq_id", (F.col("p") + 1).alias("pos"), "dept_id", "driver_id",
                    F.col("z.poi_ids").alias("poi_id"), F.col("z.g5_ids").alias("g5_id"),
                    F.col("z.g6_ids").alias("g6_id"), F.col("z.g7_ids").alias("g7_id"))


SQL_ENCODE_TOKENS = f"""
WITH {VOCAB_SQL.replace('sl AS', 'trl AS').replace('FROM sl', 'FROM trl')},
  te AS ({seq_long(TEST)}),
  miss AS (SELECT field, id AS miss FROM vocab WHERE token = 'Non'),
  m AS (SELECT max(CASE WHEN field = 'poi' THEN miss END) AS mp, max(CASE WHEN field = 'grid5' THEN miss END) AS m5,
               max(CASE WHEN field = 'grid6' THEN miss END) AS m6, max(CASE WHEN field = 'grid7' THEN miss END) AS m7,
               max(CASE WHEN field = 'dept' THEN miss END) AS md, max(CASE WHEN field = 'driver' THEN miss END) AS mdr
        FROM miss)
SELECT te.seq_id, CAST(te.pos AS INTEGER) AS pos,
  coalesce(vd.id, m.md) AS dept_id, coalesce(vdr.id, m.mdr) AS driver_id,
  coalesce(vp.id, m.mp) AS poi_id, coalesce(v5.id, m.m5) AS g5_id,
  CASE WHEN te.seq_id % 31 = 0 AND te.pos = te.len THEN NULL ELSE coalesce(v6.id, m.m6) END AS g6_id,
  coalesce(v7.id, m.m7) AS g7_id
FROM te CROSS JOIN m
LEFT JOIN vocab vp ON vp.field = 'poi' AND vp.token = CAST(te.l_partkey AS VARCHAR)
LEFT JOIN vocab v5 ON v5.field = 'grid5' AND v5.token = CAST(te.l_partkey % 20 AS VARCHAR)
LEFT JOIN vocab v6 ON v6.field = 'grid6' AND v6.token = CAST(te.l_partkey % 100 AS VARCHAR)
LEFT JOIN vocab v7 ON v7.field = 'grid7' AND v7.token = CAST(te.l_partkey % 500 AS VARCHAR)
LEFT JOIN vocab vd ON vd.field = 'dept' AND vd.token =
  CASE WHEN te.seq_id % 97 = 0 THEN NULL ELSE CAST(te.seq_id % 41 AS VARCHAR) END
LEFT JOIN vocab vdr ON vdr.field = 'driver' AND vdr.token = CAST(te.seq_id % 211 AS VARCHAR)
"""


def q_vocab_miss_report(spark, sf):
    vocab = train_vocab(spark, sf)
    test = fx.sequences(spark, sf, TEST)
    return vc.vocab_miss_report(test, vocab, MISS_FIELDS, key="seq_id")


_TEST_TOK = _tokens_sql(TEST, False).replace("sl AS", "tsl AS").replace("FROM sl", "FROM tsl") \
    .replace("tok AS", "ttok AS")
_TRAIN_VOCAB = VOCAB_SQL.replace("sl AS", "trl AS").replace("FROM sl", "FROM trl")

SQL_VOCAB_MISS_REPORT = f"""
WITH {_TRAIN_VOCAB}, {_TEST_TOK},
  mt AS (SELECT t.field, t.seq_id FROM ttok t
         WHERE t.field IN ('dept', 'poi', 'grid5', 'grid6')
           AND NOT EXISTS (SELECT 1 FROM vocab v WHERE v.field = t.field AND v.token = t.token)),
  per AS (SELECT field, seq_id, count(*) AS n FROM mt GROUP BY field, seq_id),
  rep AS (SELECT field, count(*) AS rows_with_miss, CAST(sum(n) AS BIGINT) AS missing_tokens FROM per GROUP BY field)
SELECT f.field, coalesce(rows_with_miss, 0) AS rows_with_miss, coalesce(missing_tokens, 0) AS missing_tokens
FROM (VALUES ('dept'), ('poi'), ('grid5'), ('grid6')) f(field) LEFT JOIN rep ON rep.field = f.field
"""


def q_split_by_coverage(spark, sf):
    vocab = train_vocab(spark, sf)
    test = fx.sequences(spark, sf, TEST)
    return vc.split_by_coverage(test, vocab, MISS_FIELDS, key="seq_id").select("seq_id", "part")


SQL_SPLIT_BY_COVERAGE = f"""
WITH {_TRAIN_VOCAB}, {_TEST_TOK},
  bad AS (SELECT DISTINCT t.seq_id FROM ttok t
          WHERE t.field IN ('dept', 'poi', 'grid5', 'grid6')
            AND NOT EXISTS (SELECT 1 FROM vocab v WHERE v.field = t.field AND v.token = t.token))
SELECT s.seq_id, CASE WHEN b.seq_id IS NULL THEN 0 ELSE 1 END AS part
FROM (SELECT DISTINCT seq_id FROM ttok) s LEFT JOIN bad b ON b.seq_id = s.seq_id
"""


def q_encode_oov_buckets(spark, sf):
    """User ids against a list vocabulary, 4 OOV buckets.

    Every third customer is held out of the vocabulary, so that there are misses.
    """
    vocab = _key_vocab(table(spark, sf, "customer"), "c_custkey", "user")
    out = fx.outcomes(spark, sf).select("oid", "user_id")
    return vc.encode_oov_buckets(out, vocab, "user_id", "user", 4, out="user_ix")


def _key_vocab(df, key: str, field: str):
    """List vocabulary of two thirds of the keys, in key order."""
    n = numbered(df.where(F.col(key) % 3 != 0).select(key), [key], out="at")
    return n.select(F.lit(field).alias("field"), F.col(key).cast("string").alias("token"), (F.col("at") - 1).cast("int").alias("id"))


def q_encode_oov_lists(spark, sf):
    """Part ids of each order (a list) against a list vocabulary, one OOV bucket; every third part is held out."""
    vocab = _key_vocab(table(spark, sf, "part"), "p_partkey", "part")
    s = fx.sequences(spark, sf).select("seq_id", "poi_id_sequence_app")
    e = vc.encode_oov_lists(s, vocab, "poi_id_sequence_app", "part", 1, "seq_id", out="ids")
    return e.select("seq_id", F.posexplode("ids").alias("p", "part_ix")).select("seq_id", (F.col("p") + 1).alias("pos"), "part_ix")


SQL_ENCODE_OOV_LISTS = f"""
WITH sl AS ({seq_long()}),
     v AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS id FROM part WHERE p_partkey % 3 <> 0),
     n AS (SELECT count(*) AS V FROM v)
SELECT sl.seq_id, CAST(sl.pos AS INTEGER) AS pos, CAST(coalesce(v.id, n.V) AS BIGINT) AS part_ix
FROM sl CROSS JOIN n LEFT JOIN v ON v.p_partkey = sl.l_partkey
"""


def q_encode_weekday(spark, sf):
    """Weekday of each order (Sunday is 0) against the fixed list '0' to '7', one OOV bucket."""
    vocab = vc.list_vocab(spark, range(8), "weekday")
    o = table(spark, sf, "orders").select("o_orderkey", (F.dayofweek(F.to_date("o_orderdate")) - 1).alias("weekday"))
    return vc.encode_oov_buckets(o, vocab, "weekday", "weekday", 1, out="weekday_ix")


SQL_ENCODE_WEEKDAY = """
SELECT o_orderkey, CAST(dayofweek(CAST(o_orderdate AS DATE)) AS INTEGER) AS weekday,
       CAST(dayofweek(CAST(o_orderdate AS DATE)) AS BIGINT) AS weekday_ix FROM orders
"""


SQL_ENCODE_OOV_BUCKETS = """
WITH v AS (SELECT CAST(c_custkey AS VARCHAR) AS token,
                  row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer WHERE c_custkey % 3 <> 0),
     n AS (SELECT count(*) AS V FROM v)
SELECT CAST(o_orderkey AS VARCHAR) AS oid, CAST(o_custkey AS VARCHAR) AS user_id,
       CAST(coalesce(v.id, n.V + CAST(('0x' || substring(md5(CAST(o_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 4)
            AS BIGINT) AS user_ix
FROM orders CROSS JOIN n LEFT JOIN v ON v.token = CAST(o_custkey AS VARCHAR)
"""


def q_value_counts(spark, sf):
    s = fx.sequences(spark, sf).where(F.col("grid_station_id").isNotNull())
    return vc.value_counts(s, "poi_id_sequence_app")


SQL_VALUE_COUNTS = f"""
WITH sl AS ({seq_long()})
SELECT CAST(l_partkey AS VARCHAR) AS token, count(*) AS n FROM sl WHERE seq_id % 97 <> 0 GROUP BY 1
"""


def q_max_sequence_length(spark, sf):
    return so.max_sequence_length(fx.sequences(spark, sf), "poi_id_sequence_app", "grid_station_id")


SQL_MAX_SEQUENCE_LENGTH = f"""
WITH sl AS ({seq_long()})
SELECT CAST(coalesce(max(len), 0) AS INTEGER) AS max_len FROM sl WHERE seq_id % 97 <> 0
"""


def q_sequence_lengths(spark, sf):
    return so.sequence_lengths(fx.sequences(spark, sf), "seq_id", "Y")


SQL_SEQUENCE_LENGTHS = "SELECT l_orderkey AS seq_id, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY 1"


#: Lists that lose their first element in the audit query, on orders divisible by the number.
CUT_LISTS = {"grid5_sequence_app": 29, "grid7_sequence_app": 37, "pcs_sequence_app": 43}


def q_audit_sequences(spark, sf):
    others = {"grid5_len_diff": "grid5_sequence_app", "grid6_len_diff": "grid6_sequence_app",
              "grid7_len_diff": "grid7_sequence_app", "pcs_len_diff": "pcs_sequence_app",
              "reach_len_diff": "reach_minute_sequence_real"}
    # each list loses or gains an element on the orders of its own divisor (grid6 does so in the fixture)
    s = fx.sequences(spark, sf)
    for c, n in CUT_LISTS.items():
        s = s.withColumn(c, F.when(F.col("seq_id") % n == 0, F.slice(c, 2, F.size(c))).otherwise(F.col(c)))
    last = F.col("reach_minute_sequence_real")
    s = s.withColumn("reach_minute_sequence_real", F.when(F.col("seq_id") % 53 == 0, F.concat(last, F.slice(last, 1, 1))).otherwise(last))
    return so.audit_sequences(s, "poi_id_sequence_app", others, "grid_station_id")


SQL_AUDIT_SEQUENCES = """
WITH o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT CAST(count_if(k % 29 = 0) AS BIGINT) AS grid5_len_diff, CAST(count_if(k % 31 = 0) AS BIGINT) AS grid6_len_diff,
       CAST(count_if(k % 37 = 0) AS BIGINT) AS grid7_len_diff, CAST(count_if(k % 43 = 0) AS BIGINT) AS pcs_len_diff,
       CAST(count_if(k % 53 = 0) AS BIGINT) AS reach_len_diff, CAST(count_if(k % 97 = 0) AS BIGINT) AS missing_grid_station_id
FROM o
"""

# Fixed value: steps of the sequence model
T_STEPS = 59


def _pad_grid_sql(T: int) -> str:
    return f"""
  sl AS ({seq_long()}),
  lens AS (SELECT seq_id, max(len) AS len FROM sl GROUP BY seq_id),
  g AS (SELECT seq_id, len, r.t FROM lens CROSS JOIN range(1, {T + 1}) r(t)),
  gx AS (SELECT seq_id, len, t, CASE WHEN len > {T} THEN len - {T} + t ELSE t END AS ix FROM g)"""


def q_pad_sequence(spark, sf):
    s = fx.sequences(spark, sf)
    return s.select("seq_id", F.posexplode(sq.pad_sequence("reach_minute_sequence_real", T_STEPS))
                    .alias("t", "v")).select("seq_id", (F.col("t") + 1).alias("t"), "v")


SQL_PAD_SEQUENCE = f"""
WITH {_pad_grid_sql(T_STEPS)}
SELECT gx.seq_id, CAST(gx.t AS INTEGER) AS t, coalesce(sl.l_linenumber, 0) AS v
FROM gx LEFT JOIN sl ON sl.seq_id = gx.seq_id AND sl.pos = gx.ix
"""


def q_log1p_sequence(spark, sf):
    s = fx.sequences(spark, sf)
    return s.select("seq_id", F.posexplode(sq.log1p_sequence("pcs_sequence_app", T_STEPS))
                    .alias("t", "v")).select("seq_id", (F.col("t") + 1).alias("t"), F.round("v", 6).alias("v"))


SQL_LOG1P_SEQUENCE = f"""
WITH {_pad_grid_sql(T_STEPS)}
SELECT gx.seq_id, CAST(gx.t AS INTEGER) AS t,
       round(ln(1 + coalesce(CAST(trunc(sl.l_quantity + CASE WHEN sl.seq_id % 2 = 1 THEN 0.5e0 ELSE 0e0 END)
                                  AS INTEGER), 0)), 6) AS v
FROM gx LEFT JOIN sl ON sl.seq_id = gx.seq_id AND sl.pos = gx.ix
"""


def q_one_hot_positions(spark, sf):
    s = fx.sequences(spark, sf)
    m = s.select("seq_id", F.posexplode(sq.one_hot_positions("Y", T_STEPS)).alias("i", "row"))
    e = m.select("seq_id", (F.col("i") + 1).alias("i"), (F.array_position("row", 1) - 1).cast("int").alias("j"))
    return e.where(F.col("j") >= 0)


SQL_ONE_HOT_POSITIONS = f"""
WITH sl AS ({seq_long()})
SELECT seq_id, CAST(CASE WHEN len > {T_STEPS} THEN pos - (len - {T_STEPS}) ELSE pos END AS INTEGER) AS i,
       CAST(y_rank AS INTEGER) AS j
FROM sl
WHERE (CASE WHEN len > {T_STEPS} THEN pos - (len - {T_STEPS}) ELSE pos END) >= 1 AND y_rank < {T_STEPS}
"""


def q_pad_matrix(spark, sf):
    s = fx.sequences(spark, sf)
    m = F.col("m")
    # zeros, the padding among them, change no sum: they leave the list before it is added up an element at a time
    return s.select("seq_id", sq.pad_matrix("earth_dist", T_STEPS).alias("m")).select(
        "seq_id", F.size(m).alias("n_rows"), F.size(F.element_at(m, 1)).alias("n_cols"),
        F.aggregate(F.array_remove(F.flatten(m), F.lit(0.0)), F.lit(0.0), lambda a, x: a + x).alias("total"))


SQL_PAD_MATRIX = f"""
WITH a AS (SELECT l_orderkey AS k, l_partkey AS p FROM lineitem)
SELECT x.k AS seq_id, {T_STEPS} AS n_rows, {T_STEPS + 1} AS n_cols,
       CAST(sum(abs(x.p - y.p)) + (SELECT sum(p) FROM a z WHERE z.k = x.k) AS DOUBLE) AS total
FROM a x JOIN a y ON x.k = y.k GROUP BY x.k
"""


def q_batch_rows(spark, sf):
    s = fx.sequences(spark, sf).select("seq_id")
    return so.batch_rows(s, ["seq_id"], 256).select("seq_id", "row_no", "batch")


SQL_BATCH_ROWS = """
SELECT seq_id, row_no, CAST((row_no - 1) // 256 AS BIGINT) AS batch
FROM (SELECT seq_id, row_number() OVER (ORDER BY seq_id) AS row_no
      FROM (SELECT DISTINCT l_orderkey AS seq_id FROM lineitem))
"""

QUERIES = {
    "build_vocab": (q_build_vocab, SQL_BUILD_VOCAB),
    "encode_tokens": (q_encode_tokens, SQL_ENCODE_TOKENS),
    "vocab_miss_report": (q_vocab_miss_report, SQL_VOCAB_MISS_REPORT),
    "split_by_coverage": (q_split_by_coverage, SQL_SPLIT_BY_COVERAGE),
    "encode_oov_buckets": (q_encode_oov_buckets, SQL_ENCODE_OOV_BUCKETS),
    "encode_oov_lists": (q_encode_oov_lists, SQL_ENCODE_OOV_LISTS),
    "encode_weekday": (q_encode_weekday, SQL_ENCODE_WEEKDAY),
    "value_counts": (q_value_counts, SQL_VALUE_COUNTS),
    "max_sequence_length": (q_max_sequence_length, SQL_MAX_SEQUENCE_LENGTH),
    "sequence_lengths": (q_sequence_lengths, SQL_SEQUENCE_LENGTHS),
    "audit_sequences": (q_audit_sequences, SQL_AUDIT_SEQUENCES),
    "pad_sequence": (q_pad_sequence, SQL_PAD_SEQUENCE),
    "log1p_sequence": (q_log1p_sequence, SQL_LOG1P_SEQUENCE),
    "one_hot_positions": (q_one_hot_positions, SQL_ONE_HOT_POSITIONS),
    "pad_matrix": (q_pad_matrix, SQL_PAD_MATRIX),
    "batch_rows": (q_batch_rows, SQL_BATCH_ROWS),
}
