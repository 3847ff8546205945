"""Writers: vocabularies, frequency lists, split outputs, dumps, partitions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_vocab(vocab: DataFrame, path: str) -> None:
    """Persist vocabularies ``(field, token, id)``, one folder per field."""
    vocab.write.mode("overwrite").partitionBy("field").parquet(path)


def read_vocab(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """Reload vocabularies; with ``field`` only that folder is read (partition pruning)."""
    df = spark.read.parquet(path)
    if field is not None:
        df = df.where(F.col("field") == F.lit(field))
    return df.select("field", "token", "id")


def write_value_counts(counts: DataFrame, path: str, token: str = "token", n: str = "n") -> None:
    """Frequency list as headerless CSV, most frequent first (ties by token).

    The sort is a range-partitioned global sort; files are written in order.
    """
    (counts.orderBy(F.col(n).desc(), F.col(token)).select(token, n)
           .write.mode("overwrite").csv(path, header=False))


def write_split(df: DataFrame, path: str, flag: Column | str, fmt: str = "json") -> None:
    """Route each row to ``part=0`` or ``part=1`` by a row predicate."""
    f = F.col(flag) if isinstance(flag, str) else flag
    (df.withColumn("part", f.cast("int")).write.mode("overwrite")
       .partitionBy("part").format(fmt).save(path))


def write_records_json(df: DataFrame, path: str, order, n: int = 1000) -> None:
    """First ``n`` rows by ``order`` as JSON records (a top-n: no full sort)."""
    df.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").json(path)


def write_headerless(df: DataFrame, path: str) -> None:
    """Columns side by side, no header, no index."""
    df.write.mode("overwrite").csv(path, header=False)


def name_value_lines(df: DataFrame, n: int, order) -> DataFrame:
    """First ``n`` rows as ``row \\t name \\t value`` lines (one line per field)."""
    cols = df.columns
    top = df.orderBy(*order).limit(n)
    top = top.withColumn("_row", F.monotonically_increasing_id())
    long = top.select("_row", F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"), F.lit(i).alias("fi"))
        for i, c in enumerate(cols)])).alias("kv"))
    return long.select("_row", F.col("kv.fi").alias("fi"),
                       F.concat_ws("\t", F.col("kv.name"), F.coalesce(F.col("kv.value"), F.lit("null")))
                       .alias("line"))


def write_name_value(df: DataFrame, path: str, n: int, order) -> None:
    lines = name_value_lines(df, n, order)
    lines.orderBy("_row", "fi").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_partitions(df: DataFrame, path: str, partition_cols, fmt: str = "parquet",
                     spread: int | None = None) -> None:
    """Dynamic-partition overwrite: only partitions present in ``df`` are replaced.

    Rows are first rebalanced by the partition columns: small folders get one
    file, and AQE splits a hot partition into several tasks by its measured
    size.  ``spread`` > 1 adds a salt on top, for a fixed number of files.
    """
    cols = [F.col(c) for c in partition_cols]
    if spread and spread > 1:
        cols.append(F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(spread)))
        df = df.repartition(*cols)
    else:
        df = df.hint("rebalance", *partition_cols)
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_cols).format(fmt).save(path))


#: Bytes of records that a writing task's Python holds at a time (one longer record is held alone).
ARRAY_BATCH_BYTES = 4 << 20


def write_json_arrays(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON array files, one per partition: a record on each line between
    ``[`` and ``]``, so ``scan_json_arrays`` can read them by line."""
    def frame(batches):
        first = True
        for batch in batches:
            n = batch.num_rows
            if n:
                marks = pa.array(["[" if first else ","] + [","] * (n - 1), pa.large_string())
                lines = pc.binary_join_element_wise(marks, batch.column(0).cast(pa.large_string()), pa.scalar("", pa.large_string()))
                yield pa.RecordBatch.from_arrays([lines.cast(batch.column(0).type)], names=["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names=["value"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"   # read when the write begins
    conf = df.sparkSession.conf
    before = conf.get(key)
    conf.set(key, str(ARRAY_BATCH_BYTES))
    try:
        df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(frame, "value string").write.mode(mode).text(path)
    finally:
        conf.set(key, before)
