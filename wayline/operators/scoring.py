"""Model evaluation as table jobs: mixtures, competing risks, softmax over steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values
MASK_PENALTY = -1e18   # added to the logit of an invalid candidate


def _lse(arr: Column) -> Column:
    """Stable log-sum-exp of an array."""
    m = F.array_max(arr)
    return m + F.ln(F.aggregate(arr, F.lit(0.0), lambda a, x: a + F.exp(x - m)))


def log_softmax(arr: Column) -> Column:
    lse = _lse(arr)
    return F.transform(arr, lambda x: x - lse)


def softmax(arr: Column) -> Column:
    return F.transform(log_softmax(arr), lambda x: F.exp(x))


def mixture_params(df: DataFrame, eta_d="eta_d", eta_c="eta_c", logits_d="logits_d",
                   logits_c="logits_c") -> DataFrame:
    """Rates ``exp(eta)`` and weights ``softmax(logits)`` for dispatch and cancel."""
    return df.select("*",
                     F.transform(F.col(eta_d), lambda x: F.exp(x)).alias("rate_d"),
                     F.transform(F.col(eta_c), lambda x: F.exp(x)).alias("rate_c"),
                     softmax(F.col(logits_d)).alias("w_d"),
                     softmax(F.col(logits_c)).alias("w_c"))


def _log_terms(eta: Column, logits: Column, x: Column, with_density: bool) -> Column:
    """``log(pi_k) - lambda_k x`` (+ ``eta_k`` for the density) per component."""
    lsm = log_softmax(logits)
    return F.zip_with(eta, lsm, lambda e, l: (e if with_density else F.lit(0.0)) - F.exp(e) * x + l)


def _lse_list(xs: list) -> Column:
    m = F.greatest(*xs) if len(xs) > 1 else xs[0]
    tot = xs[0] - m
    acc = F.exp(tot)
    for x in xs[1:]:
        acc = acc + F.exp(x - m)
    return m + F.ln(acc)


def _unrolled(eta: Column, logits: Column, x: Column, k: int, with_density: bool) -> Column:
    """The log-sum-exp of ``_log_terms`` with ``k`` known: plain scalar expressions
    (compiled by whole-stage code generation, unlike array lambdas)."""
    fits = (F.size(eta) == k) & (F.size(logits) == k)
    logits = F.when(fits, logits).otherwise(F.raise_error(F.lit(f"the model must have exactly {k} components")).cast("array<double>"))
    ls = [F.element_at(logits, i + 1) for i in range(k)]
    lse_l = _lse_list(ls)
    terms = []
    for i in range(k):
        e = F.element_at(eta, i + 1)
        terms.append((e if with_density else F.lit(0.0)) - F.exp(e) * x + ls[i] - lse_l)
    return _lse_list(terms)


def competing_risk_rows(df: DataFrame, xt: str = "Xt", labels=("assignd", "canceld", "timeoutd"),
                        eta_d="eta_d", eta_c="eta_c", logits_d="logits_d", logits_c="logits_c",
                        k: int | None = None) -> DataFrame:
    """Per-row negative log likelihood of the two-cause exponential mixture.

    With S(x) = sum pi e^(-lambda x) and f(x) = sum pi lambda e^(-lambda x):
    assigned = -ln f_d - ln S_c; cancelled = -ln f_c - ln S_d;
    timed out = -ln S_d - ln S_c.  All in log-sum-exp form.  With ``k`` (the
    number of components, fixed by the model) the sums are unrolled.
    """
    x = F.col(xt).cast("double")
    ed, ec, ld, lc = F.col(eta_d), F.col(eta_c), F.col(logits_d), F.col(logits_c)
    if k:
        log_fd, log_fc = _unrolled(ed, ld, x, k, True), _unrolled(ec, lc, x, k, True)
        log_sd, log_sc = _unrolled(ed, ld, x, k, False), _unrolled(ec, lc, x, k, False)
    else:
        log_fd = _lse(_log_terms(ed, ld, x, True))
        log_fc = _lse(_log_terms(ec, lc, x, True))
        log_sd = _lse(_log_terms(ed, ld, x, False))
        log_sc = _lse(_log_terms(ec, lc, x, False))
    out0 = -log_fd - log_sc
    out1 = -log_fc - log_sd
    out2 = -log_sd - log_sc
    a, c, t = (F.col(n).cast("double") for n in labels)
    return df.withColumn("nll", out0 * a + out1 * c + out2 * t)


def competing_risk_nll(df: DataFrame, **kw) -> DataFrame:
    return competing_risk_rows(df, **kw).agg(F.avg("nll").alias("loss"))


def hazard_rates(df: DataFrame, by, xt: str = "Xt", dispatch: str = "assignd",
                 cancel: str = "canceld") -> DataFrame:
    """One-component, feature-free case in closed form: events / total exposure per segment."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(
        F.try_divide(F.sum(F.col(dispatch)).cast("double"), F.sum(F.col(xt)).cast("double")).alias("rate_d"),
        F.try_divide(F.sum(F.col(cancel)).cast("double"), F.sum(F.col(xt)).cast("double")).alias("rate_c"),
        F.count(F.lit(1)).alias("n"))


def masked_softmax(df: DataFrame, group=("seq_id", "step"), logit: str = "logit",
                   valid: str = "valid") -> DataFrame:
    """Softmax per step; an invalid candidate's logit gets -1e18 added.

    Groups are steps of one sequence (bounded by the padded length T), so the
    window per step is small whatever the data size.
    """
    w = Window.partitionBy(*group)
    z = F.col(logit) + F.when(F.col(valid).cast("boolean"), F.lit(0.0)).otherwise(F.lit(MASK_PENALTY))
    x = df.withColumn("_z", z).withColumn("_m", F.max("_z").over(w))
    x = x.withColumn("_e", F.exp(F.col("_z") - F.col("_m")))
    x = x.withColumn("_s", F.sum("_e").over(w))
    return (x.withColumn("prob", F.col("_e") / F.col("_s"))
             .withColumn("log_prob", F.col("_z") - F.col("_m") - F.ln(F.col("_s")))
             .drop("_z", "_m", "_e", "_s"))


def softmax_cross_entropy(df: DataFrame, y: str = "y", **kw) -> DataFrame:
    """-sum y * log_softmax, summed over all steps (not averaged)."""
    s = masked_softmax(df, **kw)
    return s.agg(F.sum(-F.col(y) * F.col("log_prob")).alias("xent"))


def argmax_accuracy(df: DataFrame, group=("seq_id", "step"), cand: str = "cand", y: str = "y",
                    **kw) -> DataFrame:
    """Share of steps whose best candidate is the true one (ties -> lowest candidate)."""
    s = masked_softmax(df, group, **kw)
    best = s.groupBy(*group).agg(
        F.max_by(F.col(y), F.struct(F.col("prob"), -F.col(cand))).alias("_hit"))
    return best.agg(F.avg(F.col("_hit").cast("double")).alias("accuracy"))


def thresholded_accuracy(df: DataFrame, label: str = "label", p: str = "score", t: float = 0.5) -> DataFrame:
    """Share of entries where ``(p > t) = y``."""
    return df.agg(F.avg(((F.col(p) > F.lit(t)).cast("int") == F.col(label).cast("int")).cast("double"))
                  .alias("accuracy"))


def step_candidates(seqs: DataFrame, key: str, y: str, values: str) -> DataFrame:
    """Long form ``(key, step, cand, value, valid, y)`` of a pointer problem.

    Built from each row's own whole arrays; no join between rows.  Step ``t``
    (0-based) targets the candidate whose rank is ``t``; candidates already
    visited (rank < t) are invalid.
    """
    x = seqs.where(F.size(y) > 0).select(key, F.col(y).alias("_r"), F.col(values).alias("_v"))
    x = x.select(key, "_r", "_v", F.explode(F.sequence(F.lit(0), F.size("_r") - 1)).alias("step"))
    x = x.select(key, "step", F.posexplode(F.arrays_zip("_r", "_v")).alias("cand", "z"))
    return x.select(key, "step", (F.col("cand") + 1).alias("cand"), F.col("z._v").alias("value"),
                    (F.col("z._r") >= F.col("step")).alias("valid"),
                    (F.col("z._r") == F.col("step")).cast("int").alias("y"))
