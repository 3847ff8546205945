"""SQL twins of ``wayline.fixtures`` (ANSI SQL that DuckDB runs on the driver tables).

Each constant is one CTE body, used as ``WITH points AS (...)`` in oracle text.
"""

POINTS = """
  SELECT user_id AS trip, event_id AS seq, ts,
         116e0 + (event_id * 37 % 10000) / 2e4 AS lng,
         39.6e0 + (event_id * 91 % 10000) / 2e4 AS lat,
         CASE WHEN event_id % 50 = 0 THEN NULL ELSE value / 20e0 END AS spd,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS acc,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS title
  FROM events
"""

OUTCOMES = """
  SELECT strftime(o_orderdate, '%Y-%m-%d') AS dt,
         CAST(o_orderkey AS VARCHAR) AS oid,
         CAST(o_custkey AS VARCHAR) AS user_id,
         CAST(o_orderstatus = 'F' AS BIGINT) AS assignd,
         CAST(o_orderstatus = 'O' AS BIGINT) AS canceld,
         CAST(o_orderstatus = 'P' AS BIGINT) AS timeoutd,
         CAST(floor(o_totalprice / 1e3) AS BIGINT) AS Xt,
         CAST(o_custkey % 50 AS VARCHAR) AS sHexID,
         CAST(o_orderkey % 50 AS VARCHAR) AS eHexID,
         CAST(o_orderkey * 7 % 48 AS VARCHAR) AS timeSlice,
         CAST(isodow(o_orderdate) AS VARCHAR) AS dayofweek,
         [CAST(o_orderkey % 5 AS VARCHAR), '', CAST(o_orderkey % 3 AS VARCHAR)] AS reserve_partner_car_type_id,
         o_totalprice / 1e4 AS dist,
         o_totalprice AS price,
         o_orderkey AS orderkey,
         o_orderdate AS ts
  FROM orders
"""

# F3 in long form: one row per line with its 1-based position in the order.
def seq_long(where: str = "TRUE") -> str:
    return f"""
  SELECT l_orderkey AS seq_id, count(*) OVER (PARTITION BY l_orderkey) AS len,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                            l_quantity, l_extendedprice) AS pos,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber,
                            l_partkey, l_suppkey, l_quantity) - 1 AS y_rank,
         l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice
  FROM lineitem WHERE {where}
"""


SEQ_LONG = seq_long()

PREDICTIONS = """
  SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, 0.05e0 + l_discount + l_tax AS score
  FROM lineitem
"""

TWO_SAMPLES = """
  SELECT CAST(user_id % 2 AS INTEGER) AS side, event_type AS key, value / 500e0 AS score
  FROM events
"""

MATRIX = """
  SELECT l_orderkey % 100 AS i, l_suppkey AS j, sum(l_quantity) AS v
  FROM lineitem GROUP BY 1, 2
"""

VECTOR = """
  SELECT s_suppkey AS j, s_acctbal AS v FROM supplier
"""


def haversine_sql(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    return (f"(2 * 6371000e0 * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * "
            f"pow(sin((radians({lng2}) - radians({lng1})) / 2), 2))))")
