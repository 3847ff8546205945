"""Registered queries: feature frames (#36-44, #64, #65, #108-112)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline import fixtures as fx
from wayline.functions import scalars as sc
from wayline.functions.sequence import drop_empty_tokens
from wayline.operators import features as fe
from wayline.operators import stats as st
from wayline.operators import vocab as vc
from wayline.operators.ordered import written
from wayline.plans.oracle_fixtures import OUTCOMES, POINTS
from wayline.plans.q_vocab import _key_vocab
from wayline.sources.tables import table


def q_label_vector(spark, sf):
    o = fx.outcomes(spark, sf)
    lv = sc.label_vector()
    return o.select("oid", *[F.element_at(lv, i + 1).alias(n) for i, n in
                             enumerate(["y_assign", "y_cancel", "y_timeout"])],
                    F.col("Xt").cast("double").alias("xt"))


SQL_LABEL_VECTOR = f"""
WITH f AS ({OUTCOMES})
SELECT oid, CAST(assignd AS DOUBLE) AS y_assign, CAST(canceld AS DOUBLE) AS y_cancel,
       CAST(timeoutd AS DOUBLE) AS y_timeout, CAST(Xt AS DOUBLE) AS xt FROM f
"""


def _history_frame(spark, sf):
    """Orders with their user's history over all orders; the values are absent where orderkey % 7 = 0."""
    o = fx.outcomes(spark, sf)
    j = o.join(fe.user_history(o, "user_id"), "user_id", "left")
    return j.select("oid", "user_id", *[F.when(F.col("orderkey") % 7 != 0, F.col(c)).alias(c) for c in fe.USER_COLUMNS])


def q_null_indicators(spark, sf):
    j = _history_frame(spark, sf)
    n = fe.null_indicators(j, fe.USER_COLUMNS)
    return n.select("oid", "ord_num", "null_ord_num", "min_cancel_xt", "null_min_cancel_xt",
                    F.round("avg_assign_xt", 6).alias("avg_assign_xt"), "null_avg_assign_xt")


_HIST_SQL = """
  h AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS ord_num, CAST(sum(canceld) AS DOUBLE) AS ord_cancel_num,
               CAST(min(CASE WHEN canceld = 1 THEN Xt END) AS DOUBLE) AS min_cancel_xt,
               avg(CASE WHEN canceld = 1 THEN CAST(Xt AS DOUBLE) END) AS avg_cancel_xt,
               CAST(max(CASE WHEN canceld = 1 THEN Xt END) AS DOUBLE) AS max_cancel_xt,
               CAST(sum(assignd) AS DOUBLE) AS ord_assign_num,
               CAST(min(CASE WHEN assignd = 1 THEN Xt END) AS DOUBLE) AS min_assign_xt,
               avg(CASE WHEN assignd = 1 THEN CAST(Xt AS DOUBLE) END) AS avg_assign_xt,
               CAST(max(CASE WHEN assignd = 1 THEN Xt END) AS DOUBLE) AS max_assign_xt
        FROM {src} GROUP BY user_id)"""

SQL_NULL_INDICATORS = f"""
WITH f AS ({OUTCOMES}), {_HIST_SQL.format(src='f')},
j AS (SELECT f.oid, CASE WHEN orderkey % 7 <> 0 THEN ord_num END AS ord_num,
             CASE WHEN orderkey % 7 <> 0 THEN min_cancel_xt END AS min_cancel_xt,
             CASE WHEN orderkey % 7 <> 0 THEN avg_assign_xt END AS avg_assign_xt
      FROM f LEFT JOIN h ON h.user_id = f.user_id)
SELECT oid, coalesce(ord_num, 0e0) AS ord_num, CAST(ord_num IS NULL AS BIGINT) AS null_ord_num,
       coalesce(min_cancel_xt, 0e0) AS min_cancel_xt, CAST(min_cancel_xt IS NULL AS BIGINT) AS null_min_cancel_xt,
       round(coalesce(avg_assign_xt, 0e0), 6) AS avg_assign_xt, CAST(avg_assign_xt IS NULL AS BIGINT) AS null_avg_assign_xt
FROM j
"""


def q_indicator_defaults(spark, sf):
    """A customer without orders lacks the order indicators (default 1); a nation without suppliers lacks its own (default 0)."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("ord_num"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("max_part"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(
        F.max(F.when(F.col("s_acctbal") > 9000, F.col("s_acctbal"))).alias("top_bal"))
    j = (table(spark, sf, "customer").select("c_custkey", "c_nationkey")
         .join(fe.null_indicators(o, ["ord_num", "max_part"]), "c_custkey", "left")
         .join(fe.null_indicators(s, ["top_bal"]), "c_nationkey", "left"))
    names = ["null_ord_num", "null_max_part", "null_top_bal"]
    d = fe.indicator_defaults(j, names[:2], names[2:])
    return d.select("c_custkey", *[F.col(c).cast("bigint").alias(c) for c in names])


SQL_INDICATOR_DEFAULTS = """
WITH o AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS p FROM orders GROUP BY 1),
s AS (SELECT s_nationkey, max(CASE WHEN s_acctbal > 9000 THEN s_acctbal END) AS b FROM supplier GROUP BY 1)
SELECT c_custkey,
       CAST(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END AS BIGINT) AS null_ord_num,
       CAST(CASE WHEN o_custkey IS NULL OR p IS NULL THEN 1 ELSE 0 END AS BIGINT) AS null_max_part,
       CAST(CASE WHEN s_nationkey IS NULL THEN 0 WHEN b IS NULL THEN 1 ELSE 0 END AS BIGINT) AS null_top_bal
FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN s ON s_nationkey = c_nationkey
"""


def q_user_history(spark, sf):
    h = fe.user_history(fx.outcomes(spark, sf), "user_id")
    return h.select(*[F.round(c, 6).alias(c) if c.startswith("avg") else F.col(c) for c in h.columns])


SQL_USER_HISTORY = f"""
WITH f AS ({OUTCOMES}), {_HIST_SQL.format(src='f')}
SELECT user_id, ord_num, ord_cancel_num, min_cancel_xt, round(avg_cancel_xt, 6) AS avg_cancel_xt, max_cancel_xt,
       ord_assign_num, min_assign_xt, round(avg_assign_xt, 6) AS avg_assign_xt, max_assign_xt FROM h
"""


def q_scalar_functions(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        sc.default_for_zero("l_discount", -1.0).alias("dfz"),
        F.round(sc.clip(F.col("l_discount") - F.lit(0.05), 0.02), 6).alias("clipped"),
        F.round(sc.sigmoid(F.col("l_tax") * F.lit(10.0) - F.lit(0.3)), 9).alias("sig"),
        sc.format_float("l_extendedprice").alias("price_text"))


SQL_SCALAR_FUNCTIONS = """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_discount > -1e-20 AND l_discount <= 1e-20 THEN -1e0 ELSE l_discount END AS dfz,
       round(least(greatest(l_discount - 0.05e0, -0.02e0), 0.02e0), 6) AS clipped,
       round(1 / (1 + exp(-(l_tax * 10e0 - 0.3e0))), 9) AS sig,
       format('{:,.5f}', l_extendedprice) AS price_text
FROM lineitem
"""


def q_assemble_features(spark, sf):
    o = fx.outcomes(spark, sf)
    groups = {"embedding": ["sHexID", "timeSlice"], "order": ["dist"], "spacetime": ["Xt"],
              "user": ["user_id"]}
    a = fe.assemble_features(o, groups)
    return a.select("oid", F.posexplode("features").alias("ix", "v")) \
            .select("oid", "ix", F.round("v", 6).alias("v"))


SQL_ASSEMBLE_FEATURES = f"""
WITH f AS ({OUTCOMES})
SELECT oid, 0 AS ix, round(CAST(sHexID AS DOUBLE), 6) AS v FROM f
UNION ALL SELECT oid, 1, round(CAST(timeSlice AS DOUBLE), 6) FROM f
UNION ALL SELECT oid, 2, round(dist, 6) FROM f
UNION ALL SELECT oid, 3, round(CAST(Xt AS DOUBLE), 6) FROM f
"""


def q_drop_empty_tokens(spark, sf):
    o = fx.outcomes(spark, sf)
    d = drop_empty_tokens("reserve_partner_car_type_id")
    return o.select("oid", F.size(d).alias("n"), F.array_join(d, "|").alias("tokens"))


SQL_DROP_EMPTY_TOKENS = f"""
WITH f AS ({OUTCOMES})
SELECT oid, CAST(len(list_filter(reserve_partner_car_type_id, lambda x: x <> '')) AS INTEGER) AS n,
       array_to_string(list_filter(reserve_partner_car_type_id, lambda x: x <> ''), '|') AS tokens FROM f
"""


def q_format_text(spark, sf):
    p = fx.points(spark, sf)
    lng = F.format_string("%.5f", "lng")
    lat = F.format_string("%.5f", "lat")
    return p.select("seq",
                    sc.format_text("trip {0} at {1},{2}", [F.col("trip"), lng, lat]).alias("label"),
                    sc.join_fields([F.col("trip"), F.col("seq"), lng, lat], ",").alias("info"),
                    sc.join_fields([F.coalesce("title", F.lit("-")), F.col("acc")], "</br>").alias("tooltip"),
                    sc.join_fields([F.col("seq"), F.coalesce("title", F.lit("-"))], "|").alias("extra"))


SQL_FORMAT_TEXT = f"""
WITH points AS ({POINTS})
SELECT seq, 'trip ' || trip || ' at ' || printf('%.5f', lng) || ',' || printf('%.5f', lat) AS label,
       concat_ws(',', CAST(trip AS VARCHAR), CAST(seq AS VARCHAR), printf('%.5f', lng), printf('%.5f', lat)) AS info,
       concat_ws('</br>', coalesce(title, '-'), CAST(acc AS VARCHAR)) AS tooltip,
       concat_ws('|', CAST(seq AS VARCHAR), coalesce(title, '-')) AS extra
FROM points
"""


def q_time_slice(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", fe.time_slice("ts", 15).alias("slot"), fe.weekday_text("ts").alias("weekday"))


SQL_TIME_SLICE = """
SELECT event_id, CAST(CAST(floor((hour(ts) * 60 + minute(ts)) / 15) AS BIGINT) AS VARCHAR) AS slot,
       CAST(isodow(ts) AS VARCHAR) AS weekday FROM events
"""

HORIZONS = (5, 10, 15, 30)


def q_rolling_features(spark, sf):
    e = table(spark, sf, "events")
    r = fe.rolling_features(e.select("event_id", "event_type", "ts", "value"), "event_type", "ts",
                            {"Cnt": "count", "AvgValue": "avg:value"}, HORIZONS)
    cols = [F.col(f"online_Cnt{h}min") for h in HORIZONS] + \
           [F.round(f"online_AvgValue{h}min", 6).alias(f"online_AvgValue{h}min") for h in HORIZONS]
    return r.select("event_id", *cols)


SQL_ROLLING_FEATURES = "SELECT event_id, " + ", ".join(
    [f"count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL {h} MINUTES PRECEDING "
     f"AND CURRENT ROW) AS online_Cnt{h}min" for h in HORIZONS] +
    [f"round(avg(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL {h} MINUTES PRECEDING "
     f"AND CURRENT ROW), 6) AS online_AvgValue{h}min" for h in HORIZONS]) + " FROM events"


def q_shifted_window_features(spark, sf):
    e = table(spark, sf, "events")
    s = fe.shifted_window_features(e, "event_type", "ts", {"n": "count", "v": "avg:value"}, 15)
    return s.select("event_type", "window_start", "n", F.round("v", 6).alias("v"), "n_pre1",
                    F.round("v_pre1", 6).alias("v_pre1"), "n_day_ago_next",
                    F.round("v_day_ago_next", 6).alias("v_day_ago_next"))


SQL_SHIFTED_WINDOW_FEATURES = """
WITH g AS (SELECT event_type, CAST(floor(epoch_us(ts) / 900000000) AS BIGINT) * 900000000 AS ws,
                  count(*) AS n, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT g.event_type, make_timestamp(g.ws) AS window_start, g.n, round(g.v, 6) AS v,
       p.n AS n_pre1, round(p.v, 6) AS v_pre1, d.n AS n_day_ago_next, round(d.v, 6) AS v_day_ago_next
FROM g LEFT JOIN g p ON p.event_type = g.event_type AND p.ws = g.ws - 900000000
LEFT JOIN g d ON d.event_type = g.event_type AND d.ws = g.ws + 900000000 - 86400000000
"""


def _emb_ids(spark, sf):
    emb = table(spark, sf, "embeddings")
    ids = emb.select(F.col("vec_id").alias("key"),
                     F.array(F.col("vec_id"), F.col("vec_id") + 1, F.col("vec_id") + 7).alias("ids"))
    return emb, ids


def q_embedding_lookup(spark, sf):
    emb, ids = _emb_ids(spark, sf)
    r = fe.embedding_lookup(ids, "ids", emb, "key", "vec")
    return r.select("key", F.posexplode("vec").alias("ix", "v")).select("key", "ix", F.round("v", 6).alias("v"))


SQL_EMBEDDING_LOOKUP = """
WITH u AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS ix,
                  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
k AS (SELECT vec_id AS key, unnest([vec_id, vec_id + 1, vec_id + 7]) AS id FROM embeddings)
SELECT k.key, u.ix, round(avg(u.x), 6) AS v FROM k JOIN u ON u.vec_id = k.id GROUP BY k.key, u.ix
"""


def q_sum_embeddings(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    a = emb.select("vec_id", F.col("embedding").alias("e0"))
    b = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e1"))
    c = emb.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("e2"))
    j = a.join(b, "vec_id").join(c, "vec_id")
    j = j.select("vec_id", *[F.transform(x, lambda v: v.cast("double")).alias(x) for x in ("e0", "e1", "e2")],
                 F.array(F.col("vec_id").cast("double")).alias("extra"))
    s = j.select("vec_id", fe.sum_embeddings(["e0", "e1", "e2"], ["extra"]).alias("vec"))
    return s.select("vec_id", F.posexplode("vec").alias("ix", "v")).select("vec_id", "ix", F.round("v", 6).alias("v"))


SQL_SUM_EMBEDDINGS = """
WITH u AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS ix,
                  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
s AS (SELECT a.vec_id, a.ix, round(a.x + b.x + c.x, 6) AS v
      FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 AND b.ix = a.ix JOIN u c ON c.vec_id = a.vec_id + 2 AND c.ix = a.ix)
SELECT vec_id, ix, v FROM s
UNION ALL
SELECT a.vec_id, 64, round(CAST(a.vec_id AS DOUBLE), 6) FROM embeddings a
WHERE EXISTS (SELECT 1 FROM embeddings b WHERE b.vec_id = a.vec_id + 1)
  AND EXISTS (SELECT 1 FROM embeddings c WHERE c.vec_id = a.vec_id + 2)
"""

# ---- the feature frame (#37, #40): online averages as of the order, indicators, embeddings ------

#: Epoch microseconds of the first event day; orders ask at a minute of the month that follows.
EVENT_START = 1704067200000000
#: Values of the list vocabularies that are known, and unknown buckets (user ids come from ``customer``).
KNOWN = {"reserve_partner_car_type_id": (4, 1), "dayofweek": (8, 1), "timeSlice": (47, 1), "sHexID": (45, 1)}
#: Embedded columns in order, with the first position and the width of their vectors in the embedding table.
EMBEDDED = [("user_id", 1, 6), ("reserve_partner_car_type_id", 7, 3), ("dayofweek", 10, 3), ("timeSlice", 13, 3), ("sHexID", 16, 6)]
#: Vectors that stand for the rows of each column's embedding.
EMBEDDING_ROWS = 500


def _asked(spark, sf):
    """Orders with the time they asked at, spread over the month of events."""
    return fx.outcomes(spark, sf).withColumn(
        "asked", F.lit(EVENT_START) + F.col("orderkey") * 7919 % 43200 * 60_000_000)


def _online(spark, sf):
    """Orders with the twenty online averages of their start and end hex; absent where orderkey % 7 = 0."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kind = lambda name: F.col("event_type") == name
    start = {"avgCancelNumber": kind("error"), "avgScheduleNumber": kind("view"), "avgScheduleTime": F.col("value"),
             "avgSubmitNumber": kind("click")}
    w = fe.window_averages(e.withColumn("hex", (F.col("user_id") % 50).cast("string")), "hex", "ts", start)
    o = fe.online_features(_asked(spark, sf), w.withColumnRenamed("hex", "sHexID"), "sHexID", "asked", list(start))
    w = fe.window_averages(e.withColumn("hex", (F.col("k") % 50).cast("string")), "hex", "ts", {"avgSubmitNumberEnd": kind("click")})
    o = fe.online_features(o, w.withColumnRenamed("hex", "eHexID"), "eHexID", "asked", ["avgSubmitNumberEnd"])
    return o.select(*[F.when(F.col("orderkey") % 7 != 0, F.col(c)).alias(c) if c in fe.ONLINE_COLUMNS else F.col(c) for c in o.columns])


def q_online_features(spark, sf):
    n = fe.null_indicators(_online(spark, sf), fe.ONLINE_COLUMNS)
    return n.select("oid", *[F.round(c, 6).alias(c) for c in fe.ONLINE_COLUMNS], *["null_" + c for c in fe.ONLINE_COLUMNS])


def feature_frame(spark, sf):
    """Orders with ``features``: embeddings, normalised distance, absence indicators and normalised online averages, in this order."""
    f = fe.null_indicators(_online(spark, sf), fe.ONLINE_COLUMNS)
    f = f.withColumn("reserve_partner_car_type_id", drop_empty_tokens("reserve_partner_car_type_id"))
    f = f.join(fe.user_history(fx.outcomes(spark, sf), "user_id"), "user_id", "left")   # user columns are kept, not assembled
    scaled = ["dist", *fe.ONLINE_COLUMNS]
    f = rows = written(f, "features")   # read by the summary, the lists and the frame
    f = st.minmax_normalize(f, st.column_summary(f, scaled), scaled)
    users = _key_vocab(table(spark, sf, "customer"), "c_custkey", "user_id")
    emb = table(spark, sf, "embeddings").where(F.col("vec_id") < EMBEDDING_ROWS)
    for c, at, width in EMBEDDED:
        known, unknown = KNOWN.get(c, (None, 4))
        vocab = users if known is None else vc.list_vocab(spark, range(known), c)
        if c == "reserve_partner_car_type_id":
            # each different list is encoded and averaged once: orders aren't taken apart and grouped again
            lists = vc.encode_oov_lists(rows.select(c).distinct(), vocab, c, c, unknown, c, out="_ix")
            lists = lists.withColumn("_ix", F.transform("_ix", lambda i: i % EMBEDDING_ROWS))
            part = emb.select("vec_id", F.slice("embedding", at, width).alias("embedding"))
            lists = fe.embedding_lookup(lists, "_ix", part, c, "emb_" + c, dim=width).drop("_ix")
            f = f.join(lists, c, "left").withColumn("emb_" + c, F.when(F.col("oid").isNotNull(), F.col("emb_" + c)))
            continue
        f = vc.encode_oov_buckets(f, vocab, c, c, unknown, out="_ix").withColumn("_ix", F.col("_ix") % EMBEDDING_ROWS)
        part = emb.select("vec_id", F.slice("embedding", at, width).alias("embedding"))
        f = fe.embedding_lookup(f, "_ix", part, "oid", "emb_" + c, dim=width).drop("_ix")
    groups = {"embedding": ["emb_" + c for c, _, _ in EMBEDDED], "order": ["dist"],
              "spacetime": ["null_" + c for c in fe.ONLINE_COLUMNS] + fe.ONLINE_COLUMNS, "user": fe.USER_COLUMNS}
    return fe.assemble_features(f, groups)


N_FEATURES = sum(w for _, _, w in EMBEDDED) + 1 + 2 * len(fe.ONLINE_COLUMNS)


def q_feature_frame(spark, sf):
    return feature_frame(spark, sf).select("oid", F.size("features").alias("n"), *[
        F.round(F.get("features", F.lit(i)), 6).alias(f"f{i:02d}") for i in range(N_FEATURES)])


def _online_sql() -> str:
    """CTEs up to ``onl``: orders with the online averages as of their time, by ASOF joins over each horizon's windows."""
    kinds = {"avgCancelNumber": "avg(CAST(event_type = 'error' AS DOUBLE))", "avgScheduleNumber": "avg(CAST(event_type = 'view' AS DOUBLE))",
             "avgScheduleTime": "avg(value)", "avgSubmitNumber": "avg(CAST(event_type = 'click' AS DOUBLE))"}
    out = [f"""f AS ({OUTCOMES}),
o AS (SELECT *, {EVENT_START} + orderkey * 7919 % 43200 * 60000000 AS asked FROM f)"""]
    joins, cols = [], []
    for h in fe.ONLINE_HORIZONS:
        end = f"CAST((epoch_us(ts) // {h * 60000000} + 1) * {h * 60000000} AS BIGINT)"
        out.append(f"""s{h} AS (SELECT CAST(user_id % 50 AS VARCHAR) AS hex, {end} AS w, {', '.join(f'{e} AS {m}' for m, e in kinds.items())}
       FROM events GROUP BY 1, 2)""")
        out.append(f"""e{h} AS (SELECT CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 50 AS VARCHAR) AS hex, {end} AS w,
              {kinds['avgSubmitNumber']} AS avgSubmitNumberEnd FROM events GROUP BY 1, 2)""")
        joins.append(f"ASOF LEFT JOIN s{h} ON o.sHexID = s{h}.hex AND o.asked >= s{h}.w ASOF LEFT JOIN e{h} ON o.eHexID = e{h}.hex AND o.asked >= e{h}.w")
    for m in fe.ONLINE_METRICS:
        for h in fe.ONLINE_HORIZONS:
            cols.append(f"CASE WHEN orderkey % 7 <> 0 THEN {'e' if m == 'avgSubmitNumberEnd' else 's'}{h}.{m} END AS online_{m}{h}min")
    out.append("onl AS MATERIALIZED (SELECT o.*, " + ", ".join(cols) + " FROM o " + " ".join(joins) + ")")
    return "WITH " + ",\n".join(out)


SQL_ONLINE_FEATURES = _online_sql() + "\nSELECT oid, " + ", ".join(
    [f"round(coalesce({c}, 0e0), 6) AS {c}" for c in fe.ONLINE_COLUMNS]
    + [f"CAST({c} IS NULL AS BIGINT) AS null_{c}" for c in fe.ONLINE_COLUMNS]) + " FROM onl"


def _feature_sql() -> str:
    vec = lambda a, at, w: [f"{a}.v[{at + i}]" for i in range(w)]
    emb = vec("eu", 1, 6) + [f"(p1.v[{i}] + p2.v[{i}]) / 2e0" for i in (7, 8, 9)] + vec("ed", 10, 3) + vec("et", 13, 3) + vec("eh", 16, 6)
    norm = lambda c: f"(coalesce({c}, 0e0) - m.lo_{c}) / nullif(m.hi_{c} - m.lo_{c}, 0e0)"
    feats = emb + [norm("dist")] + [f"CAST({c} IS NULL AS DOUBLE)" for c in fe.ONLINE_COLUMNS] + [norm(c) for c in fe.ONLINE_COLUMNS]
    scaled = ["dist", *fe.ONLINE_COLUMNS]
    return f"""{_online_sql()},
m AS (SELECT {', '.join(f'min(coalesce({c}, 0e0)) AS lo_{c}, max(coalesce({c}, 0e0)) AS hi_{c}' for c in scaled)} FROM onl),
cv AS (SELECT CAST(c_custkey AS VARCHAR) AS token, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer WHERE c_custkey % 3 <> 0),
cn AS (SELECT count(*) AS V FROM cv),
ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < {EMBEDDING_ROWS}),
ix AS (SELECT onl.*, coalesce(cv.id, cn.V + CAST(('0x' || substring(md5(user_id), 1, 8)) AS BIGINT) % 4) % {EMBEDDING_ROWS} AS u
       FROM onl CROSS JOIN cn LEFT JOIN cv ON cv.token = user_id)
SELECT oid, {N_FEATURES} AS n, {', '.join(f'round({e}, 6) AS f{i:02d}' for i, e in enumerate(feats))}
FROM ix CROSS JOIN m
LEFT JOIN ev eu ON eu.vec_id = ix.u LEFT JOIN ev p1 ON p1.vec_id = least(orderkey % 5, 4) LEFT JOIN ev p2 ON p2.vec_id = orderkey % 3
LEFT JOIN ev ed ON ed.vec_id = CAST(dayofweek AS BIGINT) LEFT JOIN ev et ON et.vec_id = least(CAST(timeSlice AS BIGINT), 47)
LEFT JOIN ev eh ON eh.vec_id = least(CAST(sHexID AS BIGINT), 45)"""


SQL_FEATURE_FRAME = _feature_sql()

QUERIES = {
    "online_features": (q_online_features, SQL_ONLINE_FEATURES),
    "feature_frame": (q_feature_frame, SQL_FEATURE_FRAME),
    "label_vector": (q_label_vector, SQL_LABEL_VECTOR),
    "null_indicators": (q_null_indicators, SQL_NULL_INDICATORS),
    "indicator_defaults": (q_indicator_defaults, SQL_INDICATOR_DEFAULTS),
    "user_history": (q_user_history, SQL_USER_HISTORY),
    "scalar_functions": (q_scalar_functions, SQL_SCALAR_FUNCTIONS),
    "assemble_features": (q_assemble_features, SQL_ASSEMBLE_FEATURES),
    "drop_empty_tokens": (q_drop_empty_tokens, SQL_DROP_EMPTY_TOKENS),
    "format_text": (q_format_text, SQL_FORMAT_TEXT),
    "time_slice": (q_time_slice, SQL_TIME_SLICE),
    "rolling_features": (q_rolling_features, SQL_ROLLING_FEATURES),
    "shifted_window_features": (q_shifted_window_features, SQL_SHIFTED_WINDOW_FEATURES),
    "embedding_lookup": (q_embedding_lookup, SQL_EMBEDDING_LOOKUP),
    "sum_embeddings": (q_sum_embeddings, SQL_SUM_EMBEDDINGS),
}
