"""Registered queries: mixtures, competing risks, step softmax, trees (#73-82)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline import fixtures as fx
from wayline.operators import scoring as so
from wayline.operators import trees as tr
from wayline.plans.models import tree_nodes
from wayline.plans.oracle_fixtures import OUTCOMES, PREDICTIONS, seq_long
from wayline.sources.tables import table


K = 2   # mixture components per cause in the F2 parameters


def with_params(df):
    """F2 mixture parameters: constants plus multiples of (orderkey % 10), two components."""
    m = (F.col("orderkey") % 10).cast("double")
    return df.select("*",
                     F.array(F.lit(-1.0) + F.lit(0.1) * m, F.lit(-2.0) + F.lit(0.05) * m).alias("eta_d"),
                     F.array(F.lit(-1.5) + F.lit(0.02) * m, F.lit(-0.5) - F.lit(0.03) * m).alias("eta_c"),
                     F.array(F.lit(0.3) * m, F.lit(1.0)).alias("logits_d"),
                     F.array(F.lit(0.5), F.lit(-0.2) * m).alias("logits_c"))


PARAMS_SQL = f"""
  p AS (SELECT *, -1e0 + 0.1e0 * m AS ed1, -2e0 + 0.05e0 * m AS ed2, -1.5e0 + 0.02e0 * m AS ec1,
               -0.5e0 - 0.03e0 * m AS ec2, 0.3e0 * m AS ld1, 1e0 AS ld2, 0.5e0 AS lc1, -0.2e0 * m AS lc2
        FROM (SELECT *, CAST(orderkey % 10 AS DOUBLE) AS m FROM ({OUTCOMES})))"""


def q_mixture_params(spark, sf):
    p = so.mixture_params(with_params(fx.outcomes(spark, sf)))
    cols = []
    for a in ("rate_d", "rate_c", "w_d", "w_c"):
        for k in (1, 2):
            cols.append(F.round(F.element_at(a, k), 9).alias(f"{a}{k}"))
    return p.select("oid", *cols)


SQL_MIXTURE_PARAMS = f"""
WITH {PARAMS_SQL}
SELECT oid, round(exp(ed1), 9) AS rate_d1, round(exp(ed2), 9) AS rate_d2,
       round(exp(ec1), 9) AS rate_c1, round(exp(ec2), 9) AS rate_c2,
       round(exp(ld1) / (exp(ld1) + exp(ld2)), 9) AS w_d1, round(exp(ld2) / (exp(ld1) + exp(ld2)), 9) AS w_d2,
       round(exp(lc1) / (exp(lc1) + exp(lc2)), 9) AS w_c1, round(exp(lc2) / (exp(lc1) + exp(lc2)), 9) AS w_c2
FROM p
"""


def _lse2(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) + ln(exp({a} - greatest({a}, {b})) + exp({b} - greatest({a}, {b}))))"


def _nll_sql() -> str:
    lsm_d1 = f"(ld1 - {_lse2('ld1', 'ld2')})"
    lsm_d2 = f"(ld2 - {_lse2('ld1', 'ld2')})"
    lsm_c1 = f"(lc1 - {_lse2('lc1', 'lc2')})"
    lsm_c2 = f"(lc2 - {_lse2('lc1', 'lc2')})"
    x = "CAST(Xt AS DOUBLE)"
    fd = _lse2(f"(ed1 - exp(ed1) * {x} + {lsm_d1})", f"(ed2 - exp(ed2) * {x} + {lsm_d2})")
    fc = _lse2(f"(ec1 - exp(ec1) * {x} + {lsm_c1})", f"(ec2 - exp(ec2) * {x} + {lsm_c2})")
    sd = _lse2(f"(- exp(ed1) * {x} + {lsm_d1})", f"(- exp(ed2) * {x} + {lsm_d2})")
    sc = _lse2(f"(- exp(ec1) * {x} + {lsm_c1})", f"(- exp(ec2) * {x} + {lsm_c2})")
    return (f"((-{fd} - {sc}) * assignd + (-{fc} - {sd}) * canceld + (-{sd} - {sc}) * timeoutd)")


def q_competing_risk_rows(spark, sf):
    r = so.competing_risk_rows(with_params(fx.outcomes(spark, sf)), k=K)
    return r.select("oid", F.round("nll", 6).alias("nll"))


SQL_COMPETING_RISK_ROWS = f"WITH {PARAMS_SQL}\nSELECT oid, round({_nll_sql()}, 6) AS nll FROM p"


def q_competing_risk_nll(spark, sf):
    return so.competing_risk_nll(with_params(fx.outcomes(spark, sf)), k=K).select(F.round("loss", 6).alias("loss"))


SQL_COMPETING_RISK_NLL = f"WITH {PARAMS_SQL}\nSELECT round(avg({_nll_sql()}), 6) AS loss FROM p"


def q_hazard_rates(spark, sf):
    h = so.hazard_rates(fx.outcomes(spark, sf), "sHexID")
    return h.select("sHexID", F.round("rate_d", 9).alias("rate_d"), F.round("rate_c", 9).alias("rate_c"), "n")


SQL_HAZARD_RATES = f"""
WITH f AS ({OUTCOMES})
SELECT sHexID, round(sum(assignd) / nullif(sum(Xt), 0), 9) AS rate_d, round(sum(canceld) / nullif(sum(Xt), 0), 9)
       AS rate_c, count(*) AS n FROM f GROUP BY sHexID
"""


def q_scored_dump(spark, sf):
    p = so.competing_risk_rows(so.mixture_params(with_params(fx.outcomes(spark, sf))))
    return p.select("dt", "oid", "Xt", "assignd", "canceld", "timeoutd", F.round("dist", 6).alias("dist"),
                    F.round(F.element_at("rate_d", 1), 9).alias("rate_d1"),
                    F.round(F.element_at("w_d", 1), 9).alias("w_d1"),
                    F.round("nll", 6).alias("nll"))


SQL_SCORED_DUMP = f"""
WITH {PARAMS_SQL}
SELECT dt, oid, Xt, assignd, canceld, timeoutd, round(dist, 6) AS dist, round(exp(ed1), 9) AS rate_d1,
       round(exp(ld1) / (exp(ld1) + exp(ld2)), 9) AS w_d1, round({_nll_sql()}, 6) AS nll FROM p
"""


def step_scores(spark, sf):
    """F3 long form with a deterministic logit per (step, candidate)."""
    s = fx.sequences(spark, sf)
    lf = so.step_candidates(s, "seq_id", "Y", "poi_id_sequence_app")
    return lf.withColumn("logit", ((F.col("value").cast("bigint") * 7 + F.col("step") * 13) % 100) / F.lit(10.0))


STEPS_SQL = f"""
  sl AS ({seq_long()}),
  st AS (SELECT DISTINCT seq_id, len FROM sl),
  steps AS (SELECT st.seq_id, CAST(r.t AS INTEGER) AS step FROM st, LATERAL range(0, st.len) r(t)),
  lf AS (SELECT s.seq_id, s.step, CAST(sl.pos AS INTEGER) AS cand, sl.y_rank >= s.step AS valid,
                CAST(sl.y_rank = s.step AS INTEGER) AS y,
                ((sl.l_partkey * 7 + s.step * 13) % 100) / 10e0 AS logit
         FROM steps s JOIN sl ON sl.seq_id = s.seq_id),
  z0 AS (SELECT *, logit + CASE WHEN valid THEN 0e0 ELSE -1e18 END AS zz FROM lf),
  z AS (SELECT *, max(zz) OVER (PARTITION BY seq_id, step) AS mz FROM z0),
  sm AS (SELECT *, zz - mz - ln(sum(exp(zz - mz)) OVER (PARTITION BY seq_id, step)) AS lp FROM z)"""


def q_masked_softmax(spark, sf):
    m = so.masked_softmax(step_scores(spark, sf))
    return m.select("seq_id", "step", "cand", "valid", "y", F.round("prob", 9).alias("prob"))


SQL_MASKED_SOFTMAX = f"""
WITH {STEPS_SQL}
SELECT seq_id, step, cand, valid, y, round(exp(zz - mz) / sum(exp(zz - mz)) OVER (PARTITION BY seq_id, step), 9)
       AS prob
FROM z
"""


def q_softmax_cross_entropy(spark, sf):
    return so.softmax_cross_entropy(step_scores(spark, sf)).select(F.round("xent", 6).alias("xent"))


def q_argmax_accuracy(spark, sf):
    return so.argmax_accuracy(step_scores(spark, sf)).select(F.round("accuracy", 9).alias("accuracy"))


def q_thresholded_accuracy(spark, sf):
    return so.thresholded_accuracy(fx.predictions(spark, sf)).select(F.round("accuracy", 9).alias("accuracy"))


SQL_THRESHOLDED_ACCURACY = f"""
WITH p AS ({PREDICTIONS})
SELECT round(avg(CASE WHEN CAST(score > 0.5 AS INTEGER) = label THEN 1e0 ELSE 0e0 END), 9) AS accuracy FROM p
"""

FEATURES = ["f0", "f1", "f2", "f3"]


def tree_input(spark, sf):
    li = table(spark, sf, "lineitem")
    miss = F.col("l_partkey") % 11 == 0
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     F.col("l_quantity").alias("f0"), F.col("l_discount").alias("f1"),
                     F.when(miss, F.lit(-1.0)).otherwise(F.col("l_tax")).alias("f2"),
                     F.when(miss, F.lit(-1.0)).otherwise(F.col("l_linenumber").cast("double")).alias("f3"))


def q_tree_score(spark, sf):
    model = tr.read_model(tree_nodes(spark))
    s = tr.tree_score(tree_input(spark, sf), model, FEATURES, num_class=1)
    return s.select("l_orderkey", "l_linenumber", "l_partkey", F.round("score_0", 9).alias("score_0"))


def q_tree_score_multiclass(spark, sf):
    model = tr.read_model(tree_nodes(spark))
    s = tr.tree_score(tree_input(spark, sf), model, FEATURES, num_class=3)
    return s.select("l_orderkey", "l_linenumber", "l_partkey",
                    *[F.round(f"score_{k}", 9).alias(f"score_{k}") for k in range(3)])


def q_tree_attribution(spark, sf):
    model = tr.read_model(tree_nodes(spark))
    a = tr.tree_attribution(tree_input(spark, sf), model, FEATURES)
    return a.select("l_orderkey", "l_linenumber", "l_partkey",
                    *[F.round(f"contrib_{f}", 9).alias(f"contrib_{f}") for f in FEATURES + ["total"]])


def _left(f: str, default_left: bool, test: str) -> str:
    return f"(({f} < -1e-35 AND {str(default_left).upper()}) OR ({f} >= -1e-35 AND {test}))"


TREE_FEATS_SQL = """
  x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS f0, l_discount AS f1,
               CASE WHEN l_partkey % 11 = 0 THEN -1e0 ELSE l_tax END AS f2,
               CASE WHEN l_partkey % 11 = 0 THEN -1e0 ELSE CAST(l_linenumber AS DOUBLE) END AS f3
        FROM lineitem),
  lv AS (SELECT *,
    CASE WHEN {t0r} THEN (CASE WHEN {t0n1} THEN 3 ELSE 4 END) ELSE (CASE WHEN {t0n2} THEN 5 ELSE 6 END) END AS l0,
    CASE WHEN {t1r} THEN 1 ELSE (CASE WHEN {t1n2} THEN 3 ELSE 4 END) END AS l1,
    CASE WHEN {t2r} THEN 1 ELSE (CASE WHEN {t2n2} THEN 3 ELSE 4 END) END AS l2
    FROM x),
  sv AS (SELECT *,
    CASE l0 WHEN 3 THEN -0.05e0 WHEN 4 THEN -0.01e0 WHEN 5 THEN 0.04e0 ELSE 0.02e0 END AS v0,
    CASE l1 WHEN 1 THEN 0.015e0 WHEN 3 THEN -0.005e0 ELSE 0.025e0 END AS v1,
    CASE l2 WHEN 1 THEN -0.03e0 WHEN 3 THEN 0.01e0 ELSE 0.06e0 END AS v2
    FROM lv)""".format(
    t0r=_left("f0", True, "NOT f0 > 25.5e0"),
    t0n1=_left("f1", False, "NOT f1 > 0.045e0"),
    t0n2=_left("f3", False, "CAST(trunc(f3) AS INTEGER) IN (1, 3, 5)"),
    t1r=_left("f2", True, "NOT f2 > 0.04e0"),
    t1n2=_left("f0", True, "NOT f0 > 40e0"),
    t2r=_left("f3", True, "CAST(trunc(f3) AS INTEGER) IN (2, 4)"),
    t2n2=_left("f1", False, "NOT f1 > 0.08e0"))

SQL_TREE_SCORE = f"""WITH {TREE_FEATS_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, round(v0 + v1 + v2, 9) AS score_0 FROM sv"""

SQL_TREE_SCORE_MULTICLASS = f"""WITH {TREE_FEATS_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, round(v0, 9) AS score_0, round(v1, 9) AS score_1,
       round(v2, 9) AS score_2 FROM sv"""

SQL_TREE_ATTRIBUTION = f"""WITH {TREE_FEATS_SQL},
  c AS (SELECT *,
    (CASE l0 WHEN 3 THEN -0.2e0 WHEN 4 THEN -0.2e0 ELSE 0.3e0 END)
      + (CASE l1 WHEN 3 THEN -0.15e0 WHEN 4 THEN 0.15e0 ELSE 0e0 END) AS c0,
    (CASE l0 WHEN 3 THEN -0.3e0 WHEN 4 THEN 0.1e0 ELSE 0e0 END)
      + (CASE l2 WHEN 3 THEN 0.05e0 WHEN 4 THEN 0.55e0 ELSE 0e0 END) AS c1,
    (CASE l1 WHEN 1 THEN 0.1e0 ELSE 0.05e0 END) AS c2,
    (CASE l0 WHEN 5 THEN 0.1e0 WHEN 6 THEN -0.1e0 ELSE 0e0 END)
      + (CASE l2 WHEN 1 THEN -0.2e0 ELSE 0.15e0 END) AS c3
    FROM sv)
SELECT l_orderkey, l_linenumber, l_partkey, round(c0, 9) AS contrib_f0, round(c1, 9) AS contrib_f1,
       round(c2, 9) AS contrib_f2, round(c3, 9) AS contrib_f3, round(c0 + c1 + c2 + c3, 9) AS contrib_total FROM c"""

QUERIES = {
    "mixture_params": (q_mixture_params, SQL_MIXTURE_PARAMS),
    "competing_risk_rows": (q_competing_risk_rows, SQL_COMPETING_RISK_ROWS),
    "competing_risk_nll": (q_competing_risk_nll, SQL_COMPETING_RISK_NLL),
    "hazard_rates": (q_hazard_rates, SQL_HAZARD_RATES),
    "scored_dump": (q_scored_dump, SQL_SCORED_DUMP),
    "masked_softmax": (q_masked_softmax, SQL_MASKED_SOFTMAX),
    "softmax_cross_entropy": (q_softmax_cross_entropy,
                              f"WITH {STEPS_SQL}\nSELECT round(sum(-y * lp), 6) AS xent FROM sm"),
    "argmax_accuracy": (q_argmax_accuracy, f"""WITH {STEPS_SQL},
  b AS (SELECT seq_id, step, arg_max(y, (exp(lp), -cand)) AS hit FROM sm GROUP BY seq_id, step)
SELECT round(avg(CAST(hit AS DOUBLE)), 9) AS accuracy FROM b"""),
    "thresholded_accuracy": (q_thresholded_accuracy, SQL_THRESHOLDED_ACCURACY),
    "tree_score": (q_tree_score, SQL_TREE_SCORE),
    "tree_score_multiclass": (q_tree_score_multiclass, SQL_TREE_SCORE_MULTICLASS),
    "tree_attribution": (q_tree_attribution, SQL_TREE_ATTRIBUTION),
}
