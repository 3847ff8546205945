"""Loading the driver tables (one parquet file per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one table; projections and filters reach the parquet reader."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views of the named tables, for SQL templates; the path may be in any store Spark reads."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
