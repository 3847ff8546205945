"""Sequence audits and batching over rows of parallel arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.operators.ordered import numbered


def sequence_lengths(df: DataFrame, key: str, col: str = "Y") -> DataFrame:
    return df.select(key, F.size(col).alias("n"))


def max_sequence_length(df: DataFrame, col: str, require: str | None = None) -> DataFrame:
    """Longest sequence; rows whose ``require`` field is null do not count."""
    src = df.where(F.col(require).isNotNull()) if require else df
    return src.agg(F.coalesce(F.max(F.size(col)), F.lit(0)).alias("max_len"))


def audit_sequences(df: DataFrame, ref: str, others: dict, require: str) -> DataFrame:
    """One pass of conditional counts: for each other array, rows whose length
    differs from ``ref``'s; plus rows missing the ``require`` field.  Every
    mismatch is counted (the scan never stops early)."""
    aggs = [F.count_if(F.size(ref) != F.size(c)).alias(name) for name, c in others.items()]
    aggs.append(F.count_if(F.col(require).isNull()).alias("missing_" + require))
    return df.agg(*aggs)


def batch_rows(df: DataFrame, order, n: int = 256, shard: Column | None = None) -> DataFrame:
    """Fixed-size batches (last one short): ``batch = (row_no - 1) div n``.

    ``order`` may be of any orderable type; rows that tie in all of it are
    numbered in any order.  Without a ``shard`` the numbering is global; with one,
    batches restart in each shard, and a shard of any size stays spread.
    """
    d, key = (df, []) if shard is None else (df.withColumn("_shard", shard), ["_shard"])
    r = numbered(d, list(order), key, "row_no").drop("_shard")
    return r.withColumn("batch", F.floor((F.col("row_no") - 1) / F.lit(n)).cast("bigint"))
