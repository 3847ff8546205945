"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.session import scratch_path

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared checkpoint folder and read it back.

    The files outlive any executor, and two readers of the result do not run
    its plan twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(d)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fold_part(id_col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``: the split into training and held-out rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list, as rows (node, component = smallest node reachable).

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each
    round relinks every node to the smallest node among its neighbours, so the
    number of rounds grows with the logarithm of a component's size and the
    number of edges never grows.  Each round is cut by a written table.
    Hot nodes: neighbours are reduced by ``min`` with map-side combining, never
    collected.  Only the count of changed edges reaches the driver.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    cur = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: link every larger neighbour to the smallest one
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: link the smaller neighbours and the node itself to the smallest one
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low2, "u")
        small = (linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low2.select("u", F.col("m").alias("v"))).distinct())
        new = written(small, "cc")
        stars = new.agg(F.count("*").alias("n"), F.countDistinct("u").alias("d")).join(
            new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").agg(F.count("*").alias("c")))
        n, d, c = stars.first()
        drop_written(cur)
        cur = new
        if n == d and c == 0:  # every node points once, at a node that points nowhere
            break
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
