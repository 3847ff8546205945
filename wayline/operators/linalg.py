"""Sparse linear algebra as joins: ``M(i, j, v)`` matrices and ``(j, v)`` vectors."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.ordered import numbered


def dot(a: DataFrame, b: DataFrame, idx: str = "j", v: str = "v") -> DataFrame:
    """Sum of products over indices present in both (the zip of two vectors)."""
    j = a.select(idx, F.col(v).alias("_a")).join(b.select(idx, F.col(v).alias("_b")), idx)
    return j.agg(F.sum(F.col("_a") * F.col("_b")).alias("dot"))


def mat_vec(m: DataFrame, x: DataFrame, v: str = "v") -> DataFrame:
    """``y_i = sum_j M_ij x_j``: join on j, aggregate by i (partial aggregation map side)."""
    j = m.select("i", "j", F.col(v).alias("_m")).join(x.select("j", F.col(v).alias("_x")), "j")
    return j.groupBy("i").agg(F.sum(F.col("_m") * F.col("_x")).alias("y"))


def elementwise_sum(m: DataFrame, a: DataFrame, v: str = "v") -> DataFrame:
    """``sum(M o A)`` over cells present in both."""
    j = m.select("i", "j", F.col(v).alias("_m")).join(a.select("i", "j", F.col(v).alias("_a")), ["i", "j"])
    return j.agg(F.sum(F.col("_m") * F.col("_a")).alias("total"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), *[c for c in m.columns if c not in ("i", "j")])


def flatten_matrix(m: DataFrame) -> DataFrame:
    """Row-major position ``k`` (1-based) of each stored cell, by ``(i, j)``.

    Cells are numbered over range partitions, so a row of any length and any
    number of rows stay spread.
    """
    return numbered(m, ["i", "j"], out="k")


def check_constraints(a: DataFrame, x: DataFrame, rhs: DataFrame, v: str = "v", tol: float = 1e-9) -> DataFrame:
    """For a candidate ``x``: per constraint row ``i`` the value ``A_i . x``, its
    relation to ``b_i`` (``rel`` in ``<=``, ``>=``, ``==``), the verdict and the slack.

    ``rhs`` is ``(i, rel, b)``; rows of ``A`` without a stored cell give 0.
    """
    ax = mat_vec(a, x, v)
    j = rhs.join(ax, "i", "left").withColumn("ax", F.coalesce("y", F.lit(0.0))).drop("y")
    ok = (F.when(F.col("rel") == "<=", F.col("ax") <= F.col("b") + F.lit(tol))
           .when(F.col("rel") == ">=", F.col("ax") >= F.col("b") - F.lit(tol))
           .when(F.col("rel") == "==", F.abs(F.col("ax") - F.col("b")) <= F.lit(tol))
           .otherwise(F.raise_error(F.lit("unknown relation")).cast("boolean")))
    slack = F.when(F.col("rel") == ">=", F.col("ax") - F.col("b")).otherwise(F.col("b") - F.col("ax"))
    return j.select("i", "rel", "b", "ax", ok.alias("holds"), slack.alias("slack"))


def bounds_check(x: DataFrame, lo: float | None = 0.0, hi: float | None = None, v: str = "v") -> DataFrame:
    """Whether every entry of ``x`` lies in ``[lo, hi]``."""
    c = F.lit(True)
    if lo is not None:
        c = c & (F.col(v) >= F.lit(lo))
    if hi is not None:
        c = c & (F.col(v) <= F.lit(hi))
    return x.agg(F.coalesce(F.bool_and(c), F.lit(True)).alias("in_bounds"))


def objective(c: DataFrame, x: DataFrame, v: str = "v") -> DataFrame:
    """``c . x`` (primal) or ``b . y`` (dual) - a dot product."""
    return dot(c, x, "j", v).withColumnRenamed("dot", "objective")


def certificate(a: DataFrame, rhs: DataFrame, c: DataFrame, x: DataFrame, y: DataFrame, lo: float | None = 0.0,
                hi: float | None = None, v: str = "v", tol: float = 1e-9) -> DataFrame:
    """Whether ``x`` and ``y`` prove each other optimal for: maximise ``c . x`` with
    ``A x rel b`` and ``x >= 0``; minimise ``b . y`` with ``A^T y >= c``.

    ``rhs`` is ``(i, rel, b)``, ``c`` and ``x`` are ``(j, v)``, ``y`` is ``(i, v)``; entries
    that aren't stored are 0.  One row: broken primal rows (``A x rel b``), broken
    dual columns (``A^T y >= c``), entries of ``x`` outside ``[lo, hi]``, entries of
    ``y`` of the wrong sign for their row's relation, both objectives and their gap,
    rows and columns whose slack and multiplier are both non-zero, and ``optimal``.
    Two sparse products, joined by row and by column.
    """
    rows = check_constraints(a, x, rhs, v, tol).join(y.select("i", F.col(v).alias("_y")), "i", "left") \
        .withColumn("_y", F.coalesce("_y", F.lit(0.0)))
    sign = F.when(F.col("rel") == "<=", F.col("_y") >= F.lit(-tol)).when(F.col("rel") == ">=", F.col("_y") <= F.lit(tol)).otherwise(F.lit(True))
    r = rows.agg(F.count_if(~F.col("holds")).alias("rows_broken"), F.count_if(~sign).alias("y_wrong_sign"),
                 F.coalesce(F.sum(F.col("b") * F.col("_y")), F.lit(0.0)).alias("dual_objective"),
                 F.count_if(F.abs(F.col("slack") * F.col("_y")) > F.lit(tol)).alias("rows_not_complementary"))
    aty = mat_vec(transpose(a), y.select(F.col("i").alias("j"), F.col(v)), v).select(F.col("i").alias("j"), F.col("y").alias("_ay"))
    cols = (c.select("j", F.col(v).alias("_c")).join(x.select("j", F.col(v).alias("_x")), "j", "full").join(aty, "j", "full")
            .select("j", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in ("_c", "_x", "_ay")]))
    over = F.col("_ay") - F.col("_c")
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (F.col("_x") >= F.lit(lo))
    if hi is not None:
        inside = inside & (F.col("_x") <= F.lit(hi))
    k = cols.agg(F.count_if(over < F.lit(-tol)).alias("columns_broken"), F.count_if(~inside).alias("x_out_of_bounds"),
                 F.coalesce(F.sum(F.col("_c") * F.col("_x")), F.lit(0.0)).alias("primal_objective"),
                 F.count_if(F.abs(over * F.col("_x")) > F.lit(tol)).alias("columns_not_complementary"))
    one = r.join(k)   # one row each
    gap = F.col("dual_objective") - F.col("primal_objective")
    bad = ["rows_broken", "y_wrong_sign", "columns_broken", "x_out_of_bounds"]
    return one.select(*bad, "primal_objective", "dual_objective", gap.alias("gap"), "rows_not_complementary", "columns_not_complementary",
                      ((sum((F.col(n) for n in bad), F.lit(0)) == 0) & (F.abs(gap) <= F.lit(tol) * F.greatest(F.lit(1.0), F.abs("primal_objective")))).alias("optimal"))


def pair_counts(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Number of ordered pairs (n^2) and of pairs with j <= i (n(n+1)/2) per group.

    The pairs themselves are never listed: their number is quadratic in the
    group size.
    """
    g = df.groupBy(*key) if key else df.groupBy()
    a = g.agg(F.count(F.lit(1)).alias("n"))
    return a.select(*key, "n", (F.col("n") * F.col("n")).alias("cross_pairs"),
                    (F.col("n") * (F.col("n") + 1) / 2).cast("bigint").alias("triangle_pairs"))


def categorical_draw(key_col, probs: Sequence[float], seed: str = "0") -> "F.Column":
    """Category index drawn by inverse CDF from ``u = md5(seed || key) / 2^32``.

    The cumulative table is a literal array (its size is the number of
    categories), so this is a projection, not a join.
    """
    cum, s = [], 0.0
    for p in probs:
        s += p
        cum.append(s)
    cum[-1] = 1.0 + 1e-12
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key_col.cast("string"))), 1, 8), 16, 10) \
        .cast("bigint") / F.lit(4294967296.0)
    arr = F.array(*[F.lit(float(c)) for c in cum])
    return F.size(F.filter(arr, lambda c: c <= u))
