"""Registered queries: relational linear algebra, pair counts, categorical draws (#83-90)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline import fixtures as fx
from wayline.operators import linalg as la
from wayline.plans.oracle_fixtures import MATRIX, VECTOR
from wayline.sources.tables import table


def _colsums(m):
    return m.groupBy("j").agg(F.sum("v").alias("v"))


def q_dot(spark, sf):
    return la.dot(fx.vector(spark, sf), _colsums(fx.matrix(spark, sf))).select(F.round("dot", 4).alias("dot"))


SQL_DOT = f"""
WITH m AS ({MATRIX}), x AS ({VECTOR}), c AS (SELECT j, sum(v) AS v FROM m GROUP BY j)
SELECT round(sum(x.v * c.v), 4) AS dot FROM x JOIN c ON c.j = x.j
"""


def q_mat_vec(spark, sf):
    return la.mat_vec(fx.matrix(spark, sf), fx.vector(spark, sf)).select("i", F.round("y", 4).alias("y"))


SQL_MAT_VEC = f"""
WITH m AS ({MATRIX}), x AS ({VECTOR})
SELECT m.i, round(sum(m.v * x.v), 4) AS y FROM m JOIN x ON x.j = m.j GROUP BY m.i
"""


def _matrix_b(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_partkey") % 100).alias("i"), F.col("l_suppkey").alias("j")) \
             .agg(F.sum("l_quantity").alias("v"))


def q_elementwise_sum(spark, sf):
    return la.elementwise_sum(fx.matrix(spark, sf), _matrix_b(spark, sf)).select(F.round("total", 4).alias("total"))


SQL_ELEMENTWISE_SUM = f"""
WITH m AS ({MATRIX}), a AS (SELECT l_partkey % 100 AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT round(sum(m.v * a.v), 4) AS total FROM m JOIN a ON a.i = m.i AND a.j = m.j
"""


def q_transpose(spark, sf):
    return la.transpose(fx.matrix(spark, sf))


SQL_TRANSPOSE = f"WITH m AS ({MATRIX}) SELECT j AS i, i AS j, v FROM m"


def q_flatten_matrix(spark, sf):
    return la.flatten_matrix(fx.matrix(spark, sf)).select("i", "j", "k")


SQL_FLATTEN_MATRIX = f"""
WITH m AS ({MATRIX}) SELECT i, j, row_number() OVER (ORDER BY i, j) AS k FROM m
"""


def q_check_constraints(spark, sf):
    m = fx.matrix(spark, sf)
    rhs = m.groupBy("i").agg((F.sum("v") * F.lit(1000.0)).alias("b")) \
           .select("i", F.when(F.col("i") % 2 == 0, F.lit("<=")).otherwise(F.lit(">=")).alias("rel"), "b")
    c = la.check_constraints(m, fx.vector(spark, sf), rhs)
    return c.select("i", "rel", F.round("b", 4).alias("b"), F.round("ax", 4).alias("ax"),
                    F.col("holds").cast("int").alias("holds"), F.round("slack", 4).alias("slack"))


SQL_CHECK_CONSTRAINTS = f"""
WITH m AS ({MATRIX}), x AS ({VECTOR}),
r AS (SELECT i, CASE WHEN i % 2 = 0 THEN '<=' ELSE '>=' END AS rel, sum(v) * 1000e0 AS b FROM m GROUP BY i),
ax AS (SELECT m.i, sum(m.v * x.v) AS ax FROM m JOIN x ON x.j = m.j GROUP BY m.i)
SELECT r.i, r.rel, round(r.b, 4) AS b, round(coalesce(ax.ax, 0e0), 4) AS ax,
       CAST(CASE WHEN r.rel = '<=' THEN coalesce(ax.ax, 0e0) <= r.b + 1e-9
                 ELSE coalesce(ax.ax, 0e0) >= r.b - 1e-9 END AS INTEGER) AS holds,
       round(CASE WHEN r.rel = '>=' THEN coalesce(ax.ax, 0e0) - r.b ELSE r.b - coalesce(ax.ax, 0e0) END, 4) AS slack
FROM r LEFT JOIN ax ON ax.i = r.i
"""


def q_certificate(spark, sf):
    """A candidate pair over the matrix: suppliers' balances against row multipliers of the sign their relation asks."""
    m = fx.matrix(spark, sf)
    even = F.col("i") % 2 == 0
    rhs = m.groupBy("i").agg((F.sum("v") * F.lit(1000.0)).alias("b")).select(
        "i", F.when(even, F.lit("<=")).otherwise(F.lit(">=")).alias("rel"), "b")
    y = rhs.select("i", (F.when(even, F.lit(1.0)).otherwise(F.lit(-1.0)) * (F.col("i") % 5) / F.lit(10.0)).alias("v"))
    x = fx.vector(spark, sf)
    c = x.select("j", (F.col("j") % 7 * F.lit(10.0) - F.lit(30.0)).alias("v"))
    k = la.certificate(m, rhs, c, x, y, lo=0.0, hi=9000.0, tol=1e-6)
    return k.select(*[F.round(n, 2).alias(n) if n in ("primal_objective", "dual_objective", "gap") else F.col(n) for n in k.columns])


SQL_CERTIFICATE = f"""
WITH m AS ({MATRIX}), x AS ({VECTOR}),
r AS (SELECT i, CASE WHEN i % 2 = 0 THEN '<=' ELSE '>=' END AS rel, sum(v) * 1000e0 AS b FROM m GROUP BY i),
y AS (SELECT i, CASE WHEN i % 2 = 0 THEN 1e0 ELSE -1e0 END * (i % 5) / 10e0 AS y FROM r),
ax AS (SELECT m.i, sum(m.v * x.v) AS ax FROM m JOIN x ON x.j = m.j GROUP BY m.i),
p AS (SELECT count_if(NOT CASE WHEN rel = '<=' THEN coalesce(ax, 0) <= b + 1e-6 ELSE coalesce(ax, 0) >= b - 1e-6 END) AS rows_broken,
             count_if(NOT CASE WHEN rel = '<=' THEN y >= -1e-6 ELSE y <= 1e-6 END) AS y_wrong_sign, sum(b * y) AS dual_objective,
             count_if(abs((b - coalesce(ax, 0)) * y) > 1e-6) AS rows_not_complementary
      FROM r JOIN y ON y.i = r.i LEFT JOIN ax ON ax.i = r.i),
ay AS (SELECT m.j, sum(m.v * y.y) AS ay FROM m JOIN y ON y.i = m.i GROUP BY m.j),
k AS (SELECT x.j, x.v AS x, x.j % 7 * 10e0 - 30e0 AS c, coalesce(ay.ay, 0) AS ay FROM x LEFT JOIN ay ON ay.j = x.j),
d AS (SELECT count_if(ay - c < -1e-6) AS columns_broken, count_if(x < 0 OR x > 9000e0) AS x_out_of_bounds, sum(c * x) AS primal_objective,
             count_if(abs((ay - c) * x) > 1e-6) AS columns_not_complementary FROM k)
SELECT CAST(rows_broken AS BIGINT) AS rows_broken, CAST(y_wrong_sign AS BIGINT) AS y_wrong_sign, CAST(columns_broken AS BIGINT) AS columns_broken,
       CAST(x_out_of_bounds AS BIGINT) AS x_out_of_bounds, round(primal_objective, 2) AS primal_objective, round(dual_objective, 2) AS dual_objective,
       round(dual_objective - primal_objective, 2) AS gap, CAST(rows_not_complementary AS BIGINT) AS rows_not_complementary,
       CAST(columns_not_complementary AS BIGINT) AS columns_not_complementary, FALSE AS optimal
FROM p, d
"""


def q_pair_counts(spark, sf):
    return la.pair_counts(table(spark, sf, "orders"), ["o_custkey"])


SQL_PAIR_COUNTS = """
SELECT o_custkey, count(*) AS n, count(*) * count(*) AS cross_pairs,
       CAST(count(*) * (count(*) + 1) / 2 AS BIGINT) AS triangle_pairs
FROM orders GROUP BY o_custkey
"""

PROBS = (0.7, 0.1, 0.2)


def q_categorical_draw(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", la.categorical_draw(F.col("event_id"), PROBS, seed="wl").alias("category"))


SQL_CATEGORICAL_DRAW = """
WITH u AS (SELECT event_id, CAST(('0x' || substring(md5('wl' || CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT)
                  / 4294967296e0 AS u FROM events)
SELECT event_id, CAST(CASE WHEN u < 0.7e0 THEN 0 WHEN u < 0.7e0 + 0.1e0 THEN 1 ELSE 2 END AS INTEGER) AS category
FROM u
"""

QUERIES = {
    "dot": (q_dot, SQL_DOT),
    "mat_vec": (q_mat_vec, SQL_MAT_VEC),
    "elementwise_sum": (q_elementwise_sum, SQL_ELEMENTWISE_SUM),
    "transpose": (q_transpose, SQL_TRANSPOSE),
    "flatten_matrix": (q_flatten_matrix, SQL_FLATTEN_MATRIX),
    "check_constraints": (q_check_constraints, SQL_CHECK_CONSTRAINTS),
    "certificate": (q_certificate, SQL_CERTIFICATE),
    "pair_counts": (q_pair_counts, SQL_PAIR_COUNTS),
    "categorical_draw": (q_categorical_draw, SQL_CATEGORICAL_DRAW),
}
