"""Readers: partition scans, SQL scans, typed scans with defaults, text formats."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.operators.ordered import running_sum


def scan_partition(spark: SparkSession, table: str, day, n: int | None = 100,
                   partition_col: str = "dt", path: str | None = None) -> DataFrame:
    """All columns of one ``dt`` partition, spread over ``n`` partitions.

    The day is a typed literal, so the scan shows it under ``PartitionFilters``
    and only that folder is listed and read.  ``n=None`` keeps the scan's own
    split (usually better: no shuffle); the reference spread to 100.
    """
    df = spark.read.parquet(path) if path else spark.table(table)
    df = df.where(F.col(partition_col) == F.lit(day))
    return df.repartition(n) if n else df


def scan_sql(spark: SparkSession, sql: str, n: int | None = 100,
             args: Mapping | None = None) -> DataFrame:
    """A query result spread over ``n`` partitions (round robin)."""
    df = spark.sql(sql, args=dict(args)) if args else spark.sql(sql)
    return df.repartition(n) if n else df


def collect_sql(spark: SparkSession, sql: str, args: Mapping | None = None, echo: bool = True):
    """Print the statement, run it, bring the (small) result to the driver as pandas."""
    if echo:
        print(sql)
    df = spark.sql(sql, args=dict(args)) if args else spark.sql(sql)
    return df.toPandas()


class Required:
    """Marker default: the column must be present; a null raises."""


def scan_with_defaults(spark: SparkSession, path: str, schema: T.StructType,
                       defaults: Mapping[str, object], fmt: str = "parquet") -> DataFrame:
    """Typed scan; an absent value becomes the declared default.

    ``defaults[c]`` is a literal (0, 0.0, 1, "" ...), a list for array
    columns (``[]`` allows empty lists), or ``Required`` which makes a null
    an error at run time (``raise_error`` inside the projection).
    """
    df = spark.read.schema(schema).format(fmt).load(path)
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        d = defaults.get(f.name, None)
        if d is Required or isinstance(d, Required):
            c = F.coalesce(c, F.raise_error(F.lit(f"required column {f.name} is missing")).cast(f.dataType))
        elif isinstance(d, (list, tuple)):
            c = F.coalesce(c, F.array(*[F.lit(x) for x in d]).cast(f.dataType))
        elif d is not None:
            c = F.coalesce(c, F.lit(d).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def scan_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per line with an explicit schema; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def count_lines(spark: SparkSession, path: str) -> int:
    """Number of lines in a text file (a distributed count)."""
    return spark.read.text(path).count()


def parse_svmlight(line: Column) -> Column:
    """``label idx:val idx:val ...`` with zero-based indices -> struct(label, features map)."""
    toks = F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")
    feats = F.filter(F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))),
                     lambda t: ~t.startswith("qid:"))
    entries = F.transform(feats, lambda t: F.struct(
        F.split(t, ":").getItem(0).cast("int").alias("key"),
        F.split(t, ":").getItem(1).cast("double").alias("value")))
    return F.struct(F.element_at(toks, 1).cast("double").alias("label"),
                    F.map_from_entries(entries).alias("features"))


def scan_svmlight(spark: SparkSession, path: str) -> DataFrame:
    """Sparse rows ``(label double, features map<int,double>)``; index 0 is allowed."""
    t = spark.read.text(path)
    t = t.where(F.trim("value") != "")
    p = t.select(parse_svmlight(F.col("value")).alias("r"))
    return p.select("r.label", "r.features")


def numbered_lines(spark: SparkSession, path: str, out: str = "ordinal") -> DataFrame:
    """Lines of text files with their 0-based number over all files, in order of file path and line.

    Lines are numbered within the block of the file that one scan split reads;
    the counts of earlier blocks, one row for each block, are added.  Which
    task reads a block, and when, makes no difference.
    """
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    d = spark.read.text(path).select("value", block.alias("_block"), F.monotonically_increasing_id().alias("_mid"),
                                     F.lit(1).alias("_one"))
    r = running_sum(d, [], ["_mid"], ["_one"], bucket=F.col("_block"))
    return r.select("value", (F.col("cum__one") - 1).alias(out))


def scan_points_csv(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``lng,lat[,title]``; an empty line gives a null point; the title
    defaults to the line's 0-based number over all files."""
    t = numbered_lines(spark, path)
    parts = F.split(F.col("value"), ",")
    empty = F.trim(F.col("value")) == ""
    title = F.try_element_at(parts, F.lit(3))
    return t.select(
        "ordinal",
        F.when(empty, F.lit(None)).otherwise(F.try_element_at(parts, F.lit(1)).try_cast("double")).alias("lng"),
        F.when(empty, F.lit(None)).otherwise(F.try_element_at(parts, F.lit(2)).try_cast("double")).alias("lat"),
        F.coalesce(F.when(title != "", title), F.col("ordinal").cast("string")).alias("title"))


def scan_cases_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array of nested case objects (multi-line file)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def scan_json_arrays(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON array files with one record per line: each file, and each split of a file, is read apart.

    Brackets and commas around a record are taken off its line; a line that is
    no record then fails the job.  For arrays laid out otherwise use
    ``scan_cases_json``, which reads a file as a whole.
    """
    bare = F.regexp_replace(F.col("value"), r"^[\[,\s]+|[,\]\s]+$", "")
    lines = spark.read.text(path).select(bare.alias("j")).where(F.col("j") != "")
    return lines.select(F.from_json("j", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


HEX_SCHEMA = T.StructType([
    T.StructField("HexID", T.StringType()),
    T.StructField("center", T.StringType()),
    T.StructField("polygeo", T.StringType()),
    T.StructField("color", T.StringType()),
    T.StructField("desc", T.ArrayType(T.StringType())),
])


def scan_hex_json(spark: SparkSession, path: str, schema: T.StructType = HEX_SCHEMA, by_line: bool = False) -> DataFrame:
    """Hex records ``{HexID, center, polygeo, color, desc[]}``; empty ids dropped.

    ``by_line``: the arrays hold one record per line (``scan_json_arrays``)."""
    df = (scan_json_arrays if by_line else scan_cases_json)(spark, path, schema)
    return df.where(F.col("HexID").isNotNull() & (F.col("HexID") != ""))
