"""Registered queries: grouping, sampling, summaries and statistics (#45-60)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline import fixtures as fx
from wayline.operators import stats as st
from wayline.plans.oracle_fixtures import OUTCOMES, PREDICTIONS, TWO_SAMPLES
from wayline.sources.tables import table


def q_group_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    g = st.group_rows(o, "o_custkey", ["o_orderdate", "o_orderkey"], chunk=F.year("o_orderdate"))
    return g.select("o_custkey", "chunk", F.size("rows").alias("n"),
                    F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",").alias("keys"))


SQL_GROUP_ROWS = """
SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS chunk, CAST(count(*) AS INTEGER) AS n,
       string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS keys
FROM orders GROUP BY 1, 2
"""


def q_group_index(spark, sf):
    """Order keys by customer and status, in pages of four."""
    g = st.group_index(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", page=4)
    return g.select("o_custkey", F.col("o_orderstatus").alias("status"), "page", F.size("values").alias("n"),
                    F.array_join(F.transform("values", lambda k: k.cast("string")), ",").alias("keys"))


SQL_GROUP_INDEX = """
WITH o AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1) // 4 AS page FROM orders)
SELECT o_custkey, o_orderstatus AS status, CAST(page AS BIGINT) AS page, CAST(count(*) AS INTEGER) AS n,
       string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys
FROM o GROUP BY 1, 2, 3
"""


def q_index_directory(spark, sf):
    g = st.group_index(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", page=4)
    return st.index_directory(g, "o_custkey", "o_orderstatus")


SQL_INDEX_DIRECTORY = """
SELECT o_custkey, o_orderstatus, CAST(ceil(count(*) / 4e0) AS BIGINT) AS pages, count(*) AS n FROM orders GROUP BY 1, 2
"""


def q_sample_k(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return st.sample_k(o, 100, "o_orderkey", seed="wl")


SQL_SAMPLE_K = """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY md5('wl' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100
"""


def q_sample_k_strata(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return st.sample_k(o, 7, "o_orderkey", seed="wl", strata="o_orderpriority")


SQL_SAMPLE_K_STRATA = """
SELECT o_orderkey, o_orderpriority FROM (
  SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority
         ORDER BY md5('wl' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders) WHERE r <= 7
"""

SUMMARY_COLS = ["Xt", "dist", "price"]


def q_column_summary(spark, sf):
    return st.column_summary(fx.outcomes(spark, sf), SUMMARY_COLS)


SQL_COLUMN_SUMMARY = f"""
WITH f AS ({OUTCOMES})
SELECT 'Xt' AS "column", CAST(min(Xt) AS DOUBLE) AS min, CAST(max(Xt) AS DOUBLE) AS max FROM f
UNION ALL SELECT 'dist', min(dist), max(dist) FROM f
UNION ALL SELECT 'price', min(price), max(price) FROM f
"""


def q_minmax_normalize(spark, sf):
    f = fx.outcomes(spark, sf).select("oid", "Xt", "dist")
    s = st.column_summary(f, ["Xt", "dist"])
    n = st.minmax_normalize(f, s, ["Xt", "dist"])
    return n.select("oid", F.round("Xt", 6).alias("xt_n"), F.round("dist", 6).alias("dist_n"))


SQL_MINMAX_NORMALIZE = f"""
WITH f AS ({OUTCOMES})
SELECT oid, round((Xt - (SELECT min(Xt) FROM f)) / nullif((SELECT max(Xt) - min(Xt) FROM f), 0), 6) AS xt_n,
       round((dist - (SELECT min(dist) FROM f)) / nullif((SELECT max(dist) - min(dist) FROM f), 0), 6) AS dist_n
FROM f
"""


def q_auc(spark, sf):
    return st.auc(fx.predictions(spark, sf)).select(F.round("auc", 9).alias("auc"))


SQL_AUC = f"""
WITH p AS ({PREDICTIONS}),
s AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM p GROUP BY score),
c AS (SELECT score, pos, neg, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
      FROM s)
SELECT round(sum(pos * (coalesce(below, 0) + neg / 2e0)) / (sum(pos) * sum(neg)), 9) AS auc FROM c
"""


def q_logloss(spark, sf):
    return st.logloss(fx.predictions(spark, sf)).select(F.round("logloss", 9).alias("logloss"))


SQL_LOGLOSS = f"""
WITH p AS ({PREDICTIONS}), c AS (SELECT label, least(greatest(score, 1e-15), 1 - 1e-15) AS q FROM p)
SELECT round(avg(-(label * ln(q) + (1 - label) * ln(1 - q))), 9) AS logloss FROM c
"""


def q_mae(spark, sf):
    return st.mae(fx.predictions(spark, sf)).select(F.round("mae", 9).alias("mae"))


SQL_MAE = f"WITH p AS ({PREDICTIONS}) SELECT round(avg(abs(label - score)), 9) AS mae FROM p"


def q_kl_divergence(spark, sf):
    return st.kl_divergence(fx.two_samples(spark, sf)).select(
        F.round("kl_pq", 9).alias("kl_pq"), F.round("kl_qp", 9).alias("kl_qp"))


def _kl_sql(src: str) -> str:
    return f"""
WITH s AS ({src}),
n AS (SELECT sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS na, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS nb FROM s),
c AS (SELECT key, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) / max(n.na) AS p,
             sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) / max(n.nb) AS q FROM s, n GROUP BY key)
SELECT round(sum(CASE WHEN p = 0 THEN 0e0 WHEN q = 0 THEN 'inf'::DOUBLE ELSE p * ln(p / q) END), 9) AS kl_pq,
       round(sum(CASE WHEN q = 0 THEN 0e0 WHEN p = 0 THEN 'inf'::DOUBLE ELSE q * ln(q / p) END), 9) AS kl_qp
FROM c
"""


SQL_KL_DIVERGENCE = _kl_sql(TWO_SAMPLES)


def q_kl_divergence_missing(spark, sf):
    return st.kl_divergence(fx.two_samples(spark, sf, drop_category="error")).select(
        F.round("kl_pq", 9).alias("kl_pq"), F.round("kl_qp", 9).alias("kl_qp"))


SQL_KL_DIVERGENCE_MISSING = _kl_sql(
    f"SELECT * FROM ({TWO_SAMPLES}) WHERE NOT (side = 1 AND key = 'error')")


def q_variational_bounds(spark, sf):
    v = st.variational_bounds(fx.two_samples(spark, sf))
    return v.select(*[F.round(c, 9).alias(c) for c in v.columns])


SQL_VARIATIONAL_BOUNDS = f"""
WITH s AS ({TWO_SAMPLES}),
a AS (SELECT avg(CASE WHEN side = 0 THEN score END) AS e0t, avg(CASE WHEN side = 1 THEN score END) AS e1t,
             avg(CASE WHEN side = 0 THEN exp(score - 1) END) AS e0e,
             avg(CASE WHEN side = 1 THEN exp(score - 1) END) AS e1e FROM s)
SELECT round(e0t - e1e, 9) AS kl_bound, round(e1t - e0e, 9) AS reverse_kl_bound, round(e0t - e1t, 9) AS wasserstein
FROM a
"""


def q_histogram_density(spark, sf):
    h = st.histogram_density(table(spark, sf, "lineitem"), "l_quantity", 100)
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n",
                    F.round("density", 9).alias("density"))


SQL_HISTOGRAM_DENSITY = """
WITH mm AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(l_quantity) AS n FROM lineitem),
w AS (SELECT lo, hi, n, (hi - lo) / 100 AS w FROM mm),
c AS (SELECT CAST(least(floor((l_quantity - w.lo) / w.w), 99) AS INTEGER) AS bin, count(*) AS n
      FROM lineitem, w GROUP BY 1),
b AS (SELECT CAST(range AS INTEGER) AS bin FROM range(100))
SELECT b.bin, round(w.lo + b.bin * w.w, 6) AS lo, round(w.lo + (b.bin + 1) * w.w, 6) AS hi,
       coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (w.n * w.w), 9) AS density
FROM b CROSS JOIN w LEFT JOIN c ON c.bin = b.bin
"""


def q_kde(spark, sf):
    k = st.kde(table(spark, sf, "events"), "value", 32)
    return k.select("i", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


SQL_KDE = """
WITH st AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) AS sd FROM events),
h AS (SELECT lo, hi, n, sd * pow(n, -0.2) AS h FROM st),
g AS (SELECT CAST(range AS INTEGER) AS i, lo + (hi - lo) * range / 31 AS x FROM range(32), h)
SELECT g.i, round(g.x, 6) AS x,
       round(sum(exp(-0.5 * pow((g.x - e.value) / h.h, 2))) / (h.n * h.h * sqrt(2 * pi())), 9) AS density
FROM g CROSS JOIN h CROSS JOIN events e GROUP BY g.i, g.x, h.n, h.h
"""

QUERIES = {
    "group_rows": (q_group_rows, SQL_GROUP_ROWS),
    "group_index": (q_group_index, SQL_GROUP_INDEX),
    "index_directory": (q_index_directory, SQL_INDEX_DIRECTORY),
    "sample_k": (q_sample_k, SQL_SAMPLE_K),
    "sample_k_strata": (q_sample_k_strata, SQL_SAMPLE_K_STRATA),
    "column_summary": (q_column_summary, SQL_COLUMN_SUMMARY),
    "minmax_normalize": (q_minmax_normalize, SQL_MINMAX_NORMALIZE),
    "auc": (q_auc, SQL_AUC),
    "logloss": (q_logloss, SQL_LOGLOSS),
    "mae": (q_mae, SQL_MAE),
    "kl_divergence": (q_kl_divergence, SQL_KL_DIVERGENCE),
    "kl_divergence_missing": (q_kl_divergence_missing, SQL_KL_DIVERGENCE_MISSING),
    "variational_bounds": (q_variational_bounds, SQL_VARIATIONAL_BOUNDS),
    "histogram_density": (q_histogram_density, SQL_HISTOGRAM_DENSITY),
    "kde": (q_kde, SQL_KDE),
}
