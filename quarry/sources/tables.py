"""Loaders for the parquet tables the library is exercised on (S1-S3 live in delimited.py)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        if os.path.exists(table_path(sf_dir, n)):
            load(spark, sf_dir, n).createOrReplaceTempView(n)


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """A row key for tables without a unique business key. monotonically_increasing_id follows the packing of
    splits, which a changed parallelism changes, so the keyed frame is written once (a reliable
    checkpoint in the shared folder) and every later read sees the same keys."""
    from pyspark.sql import functions as F

    from quarry.session import cut_lineage
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))
