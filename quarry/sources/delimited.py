"""Delimited readers.

S1 reads with ',' / UTF-8 and falls back to ';' / ISO-8859-1 when the header parses into
at most one column. Only the first line is read on the driver to choose the dialect; the
file body is parsed by Spark's CSV source in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _header_columns(spark: SparkSession, path: str, sep: str, encoding: str) -> int:
    head = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    if not head:
        return 0
    return len(head[0][0].split(sep))


def _is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether every line decodes: one scan that stops at the first line that does not."""
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value") | F.col("value").contains("\ufffd"))
    return bad.limit(1).count() == 0


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   infer: bool = False) -> DataFrame:
    """S1: ',' + UTF-8; ';' + ISO-8859-1 (Spark 4 rejects the alias 'latin1') where the file is no UTF-8 or
    its header has one column under ',' and more under ';'."""
    sep, enc = ",", "UTF-8"
    one = _header_columns(spark, path, ",", "UTF-8") <= 1 and _header_columns(spark, path, ";", "ISO-8859-1") > 1
    if one or not _is_utf8(spark, path):
        sep, enc = ";", "ISO-8859-1"
    reader = (spark.read.option("header", True).option("sep", sep).option("encoding", enc)
              .option("mode", "PERMISSIVE").option("multiLine", False))
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def read_tsv(spark: SparkSession, path: str, schema=None, infer: bool = False) -> DataFrame:
    """S2."""
    reader = spark.read.option("header", True).option("sep", "\t")
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


ADM_COLUMNS = ["ADM1_EN", "ADM2_EN", "ADM2_PCODE", "ADM2_TYPE", "ADM3_EN", "ADM3_PCODE"]
ADM_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ADM_COLUMNS])


def read_adm_dimension(spark: SparkSession, path: str) -> DataFrame:
    """S3: administrative dimension, every column a string, names trimmed."""
    df = spark.read.option("header", True).schema(ADM_SCHEMA).csv(path)
    return trim_adm(df)


def trim_adm(df: DataFrame) -> DataFrame:
    return df.select(*[F.trim(F.col(c)).alias(c) if c.endswith("_EN") else F.col(c)
                       for c in df.columns])
