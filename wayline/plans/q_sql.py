"""Registered queries: templated SQL over the driver tables (#1-3, #18-29)."""

from __future__ import annotations


from wayline import fixtures as fx
from wayline.plans.oracle_fixtures import POINTS
from wayline.plans.sql import Ident, batch_param_view, register_sql_functions, register_udf, renamed, sql_batch, \
    sql_template, udf
from wayline.sources.tables import register_views

# ---- #23 joins --------------------------------------------------------------

JOINS = """
SELECT n.n_name AS nation, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderstatus = {status}
GROUP BY n.n_name
"""


def q_sql_joins(spark, sf):
    register_views(spark, sf)
    return sql_template(spark, JOINS, {"orders": Ident("orders"), "customer": Ident("customer"),
                                       "nation": Ident("nation"), "status": "F"})


SQL_JOINS = JOINS.format(orders="orders", customer="customer", nation="nation", status="'F'")

SEMI_ANTI = """
SELECT c_mktsegment, count(*) AS n_customers
FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = {prio})
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = {st})
GROUP BY c_mktsegment
"""


def q_sql_semi_anti(spark, sf):
    register_views(spark, sf)
    return sql_template(spark, SEMI_ANTI, {"prio": "1-URGENT", "st": "P"})


SQL_SEMI_ANTI = SEMI_ANTI.format(prio="'1-URGENT'", st="'P'")

# Band join written as an equi-join on a balance bucket plus the neighbour
# buckets.  Both sides are first counted per balance: the pairs that are tested
# grow with the different balances of a band, not with the rows that share them.
NONEQUI = """
WITH c AS (
  SELECT c_acctbal, CAST(floor(c_acctbal / {w}) AS BIGINT) AS b, count(*) AS n
  FROM customer WHERE c_custkey IS NOT NULL GROUP BY c_acctbal),
s AS (
  SELECT s_acctbal, explode(sequence(CAST(floor(s_acctbal / {w}) AS BIGINT) - 1,
                                     CAST(floor(s_acctbal / {w}) AS BIGINT) + 1)) AS b
  FROM (SELECT DISTINCT s_acctbal FROM supplier)),
near AS (
  SELECT s.s_acctbal, sum(c.n) AS n
  FROM s JOIN c ON c.b = s.b AND abs(c.c_acctbal - s.s_acctbal) <= {w}
  GROUP BY s.s_acctbal)
SELECT s.s_suppkey, sum(coalesce(near.n, 0)) AS n_close
FROM supplier s LEFT JOIN near ON near.s_acctbal = s.s_acctbal
GROUP BY s.s_suppkey
"""


def q_sql_nonequi(spark, sf):
    register_views(spark, sf)
    return sql_template(spark, NONEQUI, {"w": 25.0})


SQL_NONEQUI = """
SELECT s.s_suppkey, count(c.c_custkey) AS n_close
FROM supplier s LEFT JOIN customer c ON abs(c.c_acctbal - s.s_acctbal) <= 25e0
GROUP BY s.s_suppkey
"""

# ---- #24 aggregates ----------------------------------------------------------

AGGS = """
SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders,
       round(sum(CASE WHEN l_discount > {d} THEN l_extendedprice ELSE 0D END), 2) AS disc_rev,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_quantity), 4) AS avg_qty
FROM {t} GROUP BY l_returnflag, l_linestatus HAVING count(*) > {min_n}
"""


def q_sql_aggregates(spark, sf):
    register_views(spark, sf)
    return sql_template(spark, AGGS, {"t": Ident("lineitem"), "d": 0.05, "min_n": 10})


SQL_AGGREGATES = AGGS.replace("0D", "0e0").format(t="lineitem", d="0.05", min_n="10")

# ---- #25 grouping sets / rollup / cube ----------------------------------------

GSETS = """
SELECT l_returnflag, l_linestatus, CAST({gid} AS BIGINT) AS gid, count(*) AS n,
       round(sum(l_quantity), 2) AS qty
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())
"""
ROLLUP = """
SELECT o_orderpriority, o_orderstatus, CAST({gid} AS BIGINT) AS gid, count(*) AS n
FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)
"""
CUBE = """
SELECT o_orderpriority, o_orderstatus, CAST({gid} AS BIGINT) AS gid, count(*) AS n
FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)
"""


def q_sql_grouping_sets(spark, sf):
    register_views(spark, sf)
    return spark.sql(GSETS.format(gid="grouping_id()"))


def q_sql_rollup(spark, sf):
    register_views(spark, sf)
    return spark.sql(ROLLUP.format(gid="grouping_id()"))


def q_sql_cube(spark, sf):
    register_views(spark, sf)
    return spark.sql(CUBE.format(gid="grouping_id()"))


# ---- #26 windows ---------------------------------------------------------------

WINDOWS = """
SELECT o_custkey, o_orderkey,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn,
  CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk,
  lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_price,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
  round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS avg3
FROM orders
"""


def q_sql_windows(spark, sf):
    register_views(spark, sf)
    return spark.sql(WINDOWS)


# ---- #27 top-k -------------------------------------------------------------------

TOPK = """
SELECT o_orderkey, o_custkey, o_totalprice FROM {t}
ORDER BY o_totalprice DESC, o_orderkey LIMIT {k}
"""


def q_sql_topk(spark, sf):
    register_views(spark, sf)
    return sql_template(spark, TOPK, {"t": Ident("orders"), "k": 25})


SQL_TOPK = TOPK.format(t="orders", k=25)

# ---- #28 set operations ----------------------------------------------------------

SETOPS = """
WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'),
     b AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'union_all' AS op, count(*) AS n FROM (SELECT k FROM a UNION ALL SELECT k FROM b) x
UNION ALL SELECT 'union', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b) x
UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) x
UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) x
"""


def q_sql_setops(spark, sf):
    register_views(spark, sf)
    return spark.sql(SETOPS)


# ---- #29 scalars -------------------------------------------------------------------

SCALARS = """
SELECT event_id,
  upper(event_type) AS up, length(event_type) AS len, concat(event_type, '#', CAST(user_id AS STRING)) AS tag,
  replace(event_type, 'i', 'I') AS rep, lpad(CAST(user_id AS STRING), 5, '0') AS pad,
  year(ts) AS yr, month(ts) AS mon, CAST(ts AS DATE) AS d, hour(ts) AS hr,
  floor(value) AS fl, ceil(value) AS ce, round(sqrt(value), 4) AS sq, round(ln(value + 1), 4) AS lg,
  CAST(get_json_object(props, '$.k') AS INT) AS k,
  size(split(event_type, 'i')) AS n_parts,
  md5(event_type) AS h
FROM events
"""
SQL_SCALARS = """
SELECT event_id,
  upper(event_type) AS up, CAST(length(event_type) AS INTEGER) AS len, concat(event_type, '#', CAST(user_id AS VARCHAR)) AS tag,
  replace(event_type, 'i', 'I') AS rep, lpad(CAST(user_id AS VARCHAR), 5, '0') AS pad,
  CAST(year(ts) AS INTEGER) AS yr, CAST(month(ts) AS INTEGER) AS mon, CAST(ts AS DATE) AS d,
  CAST(hour(ts) AS INTEGER) AS hr,
  CAST(floor(value) AS BIGINT) AS fl, CAST(ceil(value) AS BIGINT) AS ce, round(sqrt(value), 4) AS sq,
  round(ln(value + 1), 4) AS lg,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  CAST(len(string_split(event_type, 'i')) AS INTEGER) AS n_parts,
  md5(event_type) AS h
FROM events
"""


def q_sql_scalars(spark, sf):
    register_views(spark, sf)
    return spark.sql(SCALARS)


TEXT_SCALARS = """
SELECT doc_id, lang, length(text) AS n_len, n_chars,
  size(split(trim(text), '\\\\s+')) AS n_words,
  upper(lang) AS ulang, md5(text) AS h,
  CAST(instr(text, ' ') AS BIGINT) AS first_space
FROM documents
"""
SQL_TEXT_SCALARS = """
SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS n_len, n_chars,
  CAST(len(regexp_split_to_array(trim(text), '\\s+')) AS INTEGER) AS n_words,
  upper(lang) AS ulang, md5(text) AS h,
  CAST(instr(text, ' ') AS BIGINT) AS first_space
FROM documents
"""


def q_sql_text_scalars(spark, sf):
    register_views(spark, sf, ["documents"])
    return spark.sql(TEXT_SCALARS)


# ---- #19 batches -------------------------------------------------------------------

BATCH = """
SELECT {label} AS label, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem WHERE l_returnflag = {flag} AND l_quantity >= {min_q}
"""


def q_sql_batch(spark, sf):
    register_views(spark, sf, ["lineitem"])
    return sql_batch(spark, BATCH, {"label": ["a", "n", "r", "extra"], "flag": ["A", "N", "R"]},
                     {"min_q": 10.0})


SQL_BATCH = "\nUNION ALL\n".join(
    BATCH.format(label=f"'{lab}'", flag=f"'{fl}'", min_q="10e0")
    for lab, fl in [("a", "A"), ("n", "N"), ("r", "R")])

def q_sql_batch_single_scan(spark, sf):
    """The same batch as one query: the zipped parameters as a small table joined once,
    so lineitem is scanned once however many tuples the batch has."""
    register_views(spark, sf, ["lineitem"])
    batch_param_view(spark, {"label": ["a", "n", "r", "extra"], "flag": ["A", "N", "R"]},
                     {"min_q": 10.0}, view="wl_batch")
    return spark.sql("""
      SELECT /*+ BROADCAST(p) */ p.label, count(*) AS n, round(sum(l.l_quantity), 2) AS qty
      FROM lineitem l JOIN wl_batch p ON l.l_returnflag = p.flag AND l.l_quantity >= p.min_q
      GROUP BY p.label""")


# ---- #1-3 scans ----------------------------------------------------------------------


def q_scan_sql(spark, sf):
    from wayline.sources.readers import scan_sql
    register_views(spark, sf, ["orders"])
    return scan_sql(spark, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > :p",
                    n=16, args={"p": 100000.0})


SQL_SCAN_SQL = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000e0"


def q_collect_sql(spark, sf):
    """#3 brings a small aggregate to the driver as pandas; the query returns the same frame."""
    from wayline.sources.readers import collect_sql
    register_views(spark, sf, ["orders"])
    text = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"
    return spark.createDataFrame(collect_sql(spark, text, echo=False))   # three rows


SQL_COLLECT_SQL = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"

# ---- #20-22 UDF and SQL functions ------------------------------------------------------


def q_udf_sql(spark, sf):
    """A vectorised (pandas) UDF registered by name and called from SQL."""
    from wayline.functions.pandas_udfs import clip_udf
    register_udf(spark, "wl_clip", clip_udf)
    register_views(spark, sf, ["lineitem"])
    return spark.sql("SELECT l_returnflag, round(sum(wl_clip(l_discount, 0.05D)), 4) AS clipped "
                     "FROM lineitem GROUP BY l_returnflag")


SQL_UDF_SQL = ("SELECT l_returnflag, round(sum(least(greatest(l_discount, -0.05e0), 0.05e0)), 4) AS clipped "
               "FROM lineitem GROUP BY l_returnflag")


def q_udf_decorated_sql(spark, sf):
    """A function registered by the decorator, and the same under another name, both called from SQL (#20)."""
    @udf(spark, "double")
    def wl_spread(a, b):
        return None if a is None or b is None else a - b

    gap = renamed("wl_gap", wl_spread)
    register_udf(spark, gap.__name__, gap, "double")
    assert wl_spread(3.0, 1.0) == gap(3.0, 1.0) == 2.0   # both stay callable
    register_views(spark, sf, ["lineitem"])
    return spark.sql("SELECT l_returnflag, round(sum(wl_spread(l_quantity, l_discount)), 2) AS spread, "
                     "round(sum(wl_gap(l_tax, l_discount)), 2) AS gap FROM lineitem GROUP BY l_returnflag")


SQL_UDF_DECORATED = ("SELECT l_returnflag, round(sum(l_quantity - l_discount), 2) AS spread, "
                     "round(sum(l_tax - l_discount), 2) AS gap FROM lineitem GROUP BY l_returnflag")


def q_sql_map_scalars(spark, sf):
    """Map functions in the pass-through SQL (#29)."""
    register_views(spark, sf, ["events"])
    return spark.sql("""
      SELECT event_id, size(m) AS n, m['k'] AS k, map_contains_key(m, 'x') AS has_x, array_join(map_keys(p), ',') AS keys,
             transform_values(m, (a, v) -> v * 2)['k'] AS twice, size(map_filter(m, (a, v) -> v > 50)) AS n_large,
             element_at(p, 'user') AS user_text, map_entries(p)[0].key AS first_key
      FROM (SELECT event_id, from_json(props, 'map<string,int>') AS m,
                   map('user', CAST(user_id AS STRING), 'type', event_type) AS p FROM events)""")


SQL_MAP_SCALARS = """
SELECT event_id, 1 AS n, k, FALSE AS has_x, 'user,type' AS keys, k * 2 AS twice, CAST(k > 50 AS INTEGER) AS n_large,
       CAST(user_id AS VARCHAR) AS user_text, 'user' AS first_key
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""


def q_json_array(spark, sf):
    register_views(spark, sf, ["events"])
    register_sql_functions(spark, ["json_array", "json_array_text"])
    return spark.sql("""
      SELECT event_id, size(a) AS n, a[0] AS first, a[1] AS second, json_array_text(a) AS back
      FROM (SELECT event_id, json_array(to_json(array(event_type, CAST(user_id AS STRING)))) AS a
            FROM events)""")


SQL_JSON_ARRAY = """
SELECT event_id, 2 AS n, event_type AS first, CAST(user_id AS VARCHAR) AS second,
       '["' || event_type || '","' || CAST(user_id AS VARCHAR) || '"]' AS back
FROM events
"""


def q_proj_hex_sql(spark, sf):
    register_sql_functions(spark, ["proj_hex"])
    fx.points(spark, sf).createOrReplaceTempView("wl_points")
    return spark.sql("SELECT proj_hex(lng, lat, 500D) AS hex_id, count(*) AS n "
                     "FROM wl_points GROUP BY 1")


def hex_sql(lng: str, lat: str, size: str) -> str:
    """DuckDB twin of proj_hex, written out."""
    x = f"(6378137e0 * radians({lng}))"
    y = f"(6378137e0 * ln(tan(pi() / 4 + radians({lat}) / 2)))"
    qf = f"((sqrt(3e0) / 3 * {x} - {y} / 3) / {size})"
    rf = f"((2 * {y} / 3) / {size})"
    return f"""(SELECT CAST(CAST({size} AS BIGINT) AS VARCHAR) || ':' ||
             CAST(CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS VARCHAR) || ':' ||
             CAST(CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS VARCHAR)
       FROM (SELECT rq, rr, rs, abs(rq - qf) AS dq, abs(rr - rf) AS dr, abs(rs - (-qf - rf)) AS ds
             FROM (SELECT qf, rf, round(qf) AS rq, round(rf) AS rr, round(-qf - rf) AS rs
                   FROM (SELECT {qf} AS qf, {rf} AS rf))))"""


SQL_PROJ_HEX = f"""
WITH points AS ({POINTS})
SELECT hex_id, count(*) AS n FROM (SELECT {hex_sql('lng', 'lat', '500e0')} AS hex_id FROM points) GROUP BY 1
"""

QUERIES = {
    "sql_joins": (q_sql_joins, SQL_JOINS),
    "sql_semi_anti": (q_sql_semi_anti, SQL_SEMI_ANTI),
    "sql_nonequi": (q_sql_nonequi, SQL_NONEQUI),
    "sql_aggregates": (q_sql_aggregates, SQL_AGGREGATES),
    "sql_grouping_sets": (q_sql_grouping_sets, GSETS.format(gid="grouping_id(l_returnflag, l_linestatus)")),
    "sql_rollup": (q_sql_rollup, ROLLUP.format(gid="grouping_id(o_orderpriority, o_orderstatus)")),
    "sql_cube": (q_sql_cube, CUBE.format(gid="grouping_id(o_orderpriority, o_orderstatus)")),
    "sql_windows": (q_sql_windows, WINDOWS),
    "sql_topk": (q_sql_topk, SQL_TOPK),
    "sql_setops": (q_sql_setops, SETOPS),
    "sql_scalars": (q_sql_scalars, SQL_SCALARS),
    "sql_text_scalars": (q_sql_text_scalars, SQL_TEXT_SCALARS),
    "sql_batch": (q_sql_batch, SQL_BATCH),
    "sql_batch_single_scan": (q_sql_batch_single_scan, SQL_BATCH),
    "scan_sql": (q_scan_sql, SQL_SCAN_SQL),
    "collect_sql": (q_collect_sql, SQL_COLLECT_SQL),
    "udf_sql": (q_udf_sql, SQL_UDF_SQL),
    "udf_decorated_sql": (q_udf_decorated_sql, SQL_UDF_DECORATED),
    "sql_map_scalars": (q_sql_map_scalars, SQL_MAP_SCALARS),
    "json_array": (q_json_array, SQL_JSON_ARRAY),
    "proj_hex_sql": (q_proj_hex_sql, SQL_PROJ_HEX),
}
