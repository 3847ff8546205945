"""Registered queries: row shaping over orders joined with customers (#30-35)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import shape as sh
from wayline.sources.tables import table


def _nested(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey) \
         .join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.col("o_orderkey"),
                    F.struct("c_name", F.struct("n_name", F.struct("r_name").alias("region")).alias("nation"))
                     .alias("cust"),
                    F.col("o_totalprice"))


def q_flatten_pair(spark, sf):
    o = table(spark, sf, "orders")
    pairs = o.select(F.struct("o_orderkey", "o_custkey").alias("key"), F.col("o_totalprice").alias("value"))
    return sh.flatten_pair(pairs)


SQL_FLATTEN_PAIR = "SELECT o_orderkey, o_custkey, o_totalprice AS value FROM orders"


def q_flatten_struct(spark, sf):
    return sh.flatten_struct(_nested(spark, sf))


SQL_FLATTEN_STRUCT = """
SELECT o_orderkey, c_name, n_name, r_name, o_totalprice
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""


def q_flatten_struct_keep(spark, sf):
    f = sh.flatten_struct(_nested(spark, sf), keep=("region",))
    return f.select("o_orderkey", "c_name", "n_name", F.col("region.r_name").alias("kept_region"))


SQL_FLATTEN_STRUCT_KEEP = """
SELECT o_orderkey, c_name, n_name, r_name AS kept_region
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""


def q_take_value(spark, sf):
    o = table(spark, sf, "orders")
    pairs = o.select(F.col("o_orderkey").alias("key"), F.struct("o_totalprice", "o_orderstatus").alias("value"))
    return sh.take_value(pairs)


SQL_TAKE_VALUE = "SELECT o_totalprice, o_orderstatus FROM orders"


def q_guard(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sh.guard(o, F.col("o_totalprice") > 0, "order with a non-positive price")


SQL_GUARD = "SELECT o_orderkey, o_totalprice FROM orders"


def q_view_row(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                                          "o_orderpriority")
    return sh.view_row(o, "o_orderkey")


SQL_VIEW_ROW = """
SELECT o_orderkey, 'o_custkey' AS name, CAST(o_custkey AS VARCHAR) AS value, 'bigint' AS type FROM orders
UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus, 'string' FROM orders
UNION ALL SELECT o_orderkey, 'o_orderdate', CAST(o_orderdate AS VARCHAR), 'timestamp_ntz' FROM orders
UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority, 'string' FROM orders
"""


def q_page(spark, sf):
    o = table(spark, sf, "orders")
    return sh.page(o, ["o_orderkey"], 20, 10, ["o_orderkey", "o_custkey", "o_orderstatus"])


SQL_PAGE = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20"


def q_page_transposed(spark, sf):
    o = table(spark, sf, "orders")
    return sh.page(o, ["o_orderkey"], 20, 3, ["o_orderkey", "o_custkey", "o_orderstatus"], transposed=True)


SQL_PAGE_TRANSPOSED = """
WITH p AS (SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn
           FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 3 OFFSET 20))
SELECT 'o_orderkey' AS field, max(CASE WHEN rn = 0 THEN CAST(o_orderkey AS VARCHAR) END) AS "0",
       max(CASE WHEN rn = 1 THEN CAST(o_orderkey AS VARCHAR) END) AS "1",
       max(CASE WHEN rn = 2 THEN CAST(o_orderkey AS VARCHAR) END) AS "2" FROM p
UNION ALL SELECT 'o_custkey', max(CASE WHEN rn = 0 THEN CAST(o_custkey AS VARCHAR) END),
       max(CASE WHEN rn = 1 THEN CAST(o_custkey AS VARCHAR) END), max(CASE WHEN rn = 2 THEN CAST(o_custkey AS VARCHAR) END) FROM p
UNION ALL SELECT 'o_orderstatus', max(CASE WHEN rn = 0 THEN o_orderstatus END),
       max(CASE WHEN rn = 1 THEN o_orderstatus END), max(CASE WHEN rn = 2 THEN o_orderstatus END) FROM p
"""

QUERIES = {
    "flatten_pair": (q_flatten_pair, SQL_FLATTEN_PAIR),
    "flatten_struct": (q_flatten_struct, SQL_FLATTEN_STRUCT),
    "flatten_struct_keep": (q_flatten_struct_keep, SQL_FLATTEN_STRUCT_KEEP),
    "take_value": (q_take_value, SQL_TAKE_VALUE),
    "guard": (q_guard, SQL_GUARD),
    "view_row": (q_view_row, SQL_VIEW_ROW),
    "page": (q_page, SQL_PAGE),
    "page_transposed": (q_page_transposed, SQL_PAGE_TRANSPOSED),
}
