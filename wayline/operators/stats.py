"""Grouping, sampling, summaries and statistics as aggregate jobs."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.ordered import RUN, numbered, totals_before


def group_rows(df: DataFrame, key: str, order: Sequence[str], chunk: Column | None = None,
               out: str = "rows") -> DataFrame:
    """Each key's rows as an ordered array of structs.

    With ``chunk`` (a column monotone in ``order``, e.g. the year of a date)
    a key is split into ``(key, chunk)`` groups, so one hot key never builds
    one unbounded array in one task; chunks are ordered and together hold
    every row.
    """
    order = list(order)
    rest = [c for c in df.columns if c not in order and c != key]
    row = F.struct(*[F.col(c) for c in order + rest])
    keys = [key] if chunk is None else [key, chunk.alias("chunk")]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias(out))


def group_index(df: DataFrame, f: str, index_f: str, value: str, page: int = 1024) -> DataFrame:
    """Two-level grouping ``f -> index_f -> values`` as pages ``(f, index_f, page, values)``.

    Values are in order; each page holds ``page`` of them (the last one fewer), so no
    list grows with a key's rows.  ``index_directory`` says which pages a key has.
    """
    src = df.select(f, index_f, value).withColumn("_tie", F.monotonically_increasing_id())
    n = numbered(src, [value, "_tie"], [f, index_f], "_pos")
    at = F.floor((F.col("_pos") - 1) / F.lit(page)).cast("bigint")
    return n.groupBy(f, index_f, at.alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", value))), lambda s: s[value]).alias("values"))


def index_directory(pages: DataFrame, f: str, index_f: str) -> DataFrame:
    """``(f, index_f, pages, n)``: number of pages and of values of each key pair."""
    return pages.groupBy(f, index_f).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.size("values")).alias("n"))


def sample_k(df: DataFrame, k: int, key: str, seed: str = "0", strata: str | None = None) -> DataFrame:
    """Exactly ``min(k, n)`` rows, uniformly, deterministic for a seed.

    Rows are ranked by ``md5(seed || key)``; the global form is a top-k
    (each partition keeps its own k best, then one merge of ``k x partitions``
    rows).  With ``strata`` the top k is taken per stratum.
    """
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    if strata is None:
        return df.withColumn("_h", h).orderBy("_h", key).limit(k).drop("_h")
    w = Window.partitionBy(strata).orderBy(h, F.col(key))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def column_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, min, max)`` per numeric column: one aggregate, then unpivot."""
    row = df.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))
                   .alias(c) for c in cols])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c)["min"].alias("min"), F.col(c)["max"].alias("max"))
        for c in cols])))


def minmax_normalize(df: DataFrame, summary: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(v - min) / (max - min)``; a constant column gives null.

    The summary is two numbers per column; it is read once and used as
    literals (no join, no broadcast of anything that grows with the data).
    """
    s = {r["column"]: (r["min"], r["max"]) for r in summary.where(F.col("column").isin(list(cols))).collect()}
    out = []
    for c in df.columns:
        if c in cols:
            lo, hi = s[c]
            out.append(F.try_divide(F.col(c) - F.lit(lo), F.lit(hi) - F.lit(lo)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve, ties counting one half.

    Rows are first aggregated by score (positives, negatives).  Scores are
    range-partitioned; each run gives its positives, its negatives and the pairs it
    ranks right by itself.  Merging the runs in order adds, for each, its positives
    times the negatives of all earlier runs: one row per partition.
    """
    by = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"),
                               F.sum((1 - F.col(label).cast("long"))).alias("neg"))
    r = totals_before(by, [score], "neg")
    per = r.groupBy(RUN).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
                             F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / F.lit(2.0))).alias("own"))
    w = Window.orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)   # one row per run
    m = per.select("pos", "neg", "own", F.coalesce(F.sum("neg").over(w), F.lit(0)).alias("below"))
    return m.agg((F.sum(F.col("own") + F.col("pos") * F.col("below")) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def logloss(df: DataFrame, label: str = "label", p: str = "score", eps: float = 1e-15) -> DataFrame:
    """Mean negative log likelihood with ``p`` clipped to ``[eps, 1 - eps]``."""
    pc = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    return df.agg(F.avg(-(y * F.ln(pc) + (1 - y) * F.ln(1 - pc))).alias("logloss"))


def mae(df: DataFrame, label: str = "label", p: str = "score") -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(label) - F.col(p))).alias("mae"))


def kl_divergence(df: DataFrame, side: str = "side", key: str = "key") -> DataFrame:
    """KL(P||Q) and KL(Q||P) between the category frequencies of side 0 (P) and side 1 (Q).

    Divides by the true counts of each side.  ``p = 0`` adds 0; ``q = 0 < p``
    gives +infinity; null where a side has no rows.  One aggregation by key,
    then one over the keys: with counts a of A and b of B, the sum of
    a/A ln((a/A) / (b/B)) is (sum of a ln(a/b)) / A + ln(B/A).
    """
    c = df.groupBy(key).agg(F.count_if(F.col(side) == 0).alias("a"),
                            F.count_if(F.col(side) == 1).alias("b"))

    def divergence(x, y):
        a, b = F.col(x), F.col(y)
        term = F.when(a == 0, F.lit(0.0)).when(b == 0, F.lit(float("inf"))).otherwise(a * F.ln(a / b))
        return F.try_divide(F.sum(term), F.sum(a)) + F.ln(F.try_divide(F.sum(b), F.sum(a)))
    return c.agg(divergence("a", "b").alias("kl_pq"), divergence("b", "a").alias("kl_qp"))


def variational_bounds(df: DataFrame, side: str = "side", score: str = "score") -> DataFrame:
    """From critic scores T: the KL lower bound ``E0[T] - E1[exp(T - 1)]``, its
    reverse (sides swapped) and the Wasserstein form ``E0[T] - E1[T]``."""
    s0 = F.col(side) == 0
    s1 = F.col(side) == 1
    t = F.col(score)
    e = F.exp(t - 1)
    a = df.agg(F.avg(F.when(s0, t)).alias("e0t"), F.avg(F.when(s1, t)).alias("e1t"),
               F.avg(F.when(s0, e)).alias("e0e"), F.avg(F.when(s1, e)).alias("e1e"))
    return a.select((F.col("e0t") - F.col("e1e")).alias("kl_bound"),
                    (F.col("e1t") - F.col("e0e")).alias("reverse_kl_bound"),
                    (F.col("e0t") - F.col("e1t")).alias("wasserstein"))


def histogram_density(df: DataFrame, c: str, bins: int = 100) -> DataFrame:
    """Equal-width bins over ``[min, max]`` (last bin closed); density ``n_i / (n * w)``.

    Every bin is listed, empty ones with 0.  ``min``/``max``/``n`` are one
    aggregate read back as three numbers.
    """
    mm = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n")).first()
    lo, hi, n = float(mm["lo"]), float(mm["hi"]), int(mm["n"])
    w = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(c).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    allb = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    j = allb.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    return j.select("bin", (F.lit(lo) + F.col("bin") * F.lit(w)).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(w)).alias("hi"), "n",
                    (F.col("n") / F.lit(n * w)).alias("density"))


def kde(df: DataFrame, c: str, grid_n: int = 32, grid: Sequence[float] | None = None) -> DataFrame:
    """Gaussian kernel density on a grid; bandwidth ``sd * n^(-1/5)`` (Scott).

    Rows are first aggregated by value (weights), then each distinct value
    adds its kernel to every grid point (a literal array of ``grid_n``
    points), and contributions are summed per grid point.
    """
    st = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n"),
                F.stddev_samp(c).alias("sd")).first()
    n, sd = int(st["n"]), float(st["sd"])
    h = sd * n ** (-0.2)
    if grid is None:
        lo, hi = float(st["lo"]), float(st["hi"])
        grid = [lo + (hi - lo) * i / (grid_n - 1) for i in range(grid_n)]
    g = F.array(*[F.lit(float(x)) for x in grid])
    w = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("x")).agg(F.count(F.lit(1)).alias("w"))
    k = F.lit(1.0 / (n * h * math.sqrt(2 * math.pi)))
    contrib = w.select(F.posexplode(F.transform(g, lambda gx: F.struct(
        gx.alias("gx"), (F.col("w") * F.exp(F.lit(-0.5) * F.pow((gx - F.col("x")) / F.lit(h), 2))).alias("v"))))
        .alias("i", "p"))
    return (contrib.groupBy("i").agg(F.first(F.col("p.gx")).alias("x"), F.sum(F.col("p.v")).alias("s"))
                   .select("i", "x", (F.col("s") * k).alias("density")))
