"""Sinks and the per-run result store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, no index column (a BOM is not reproduced)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, nested structs kept."""
    df.write.mode(mode).json(path)


def save_result(df: DataFrame, root: str, table: str, file_id: str) -> None:
    """S6 persist: result tables partitioned by file_id, dynamic partition overwrite so a
    re-run replaces only its own partition."""
    (df.withColumn("file_id", F.lit(file_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("file_id").parquet(f"{root}/{table}"))


def load_result(spark: SparkSession, root: str, table: str, file_id: str) -> DataFrame:
    """S6 fetch: partition-pruned read of one run's results."""
    return spark.read.parquet(f"{root}/{table}").filter(F.col("file_id") == file_id)


def clear_results(spark: SparkSession, root: str, table: str, file_id: str) -> bool:
    """S6 clear: one run's partition goes; the others stay. Returns whether there was one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/file_id={file_id}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True))
