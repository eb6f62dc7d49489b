"""Schema partition into numeric / categorical / temporal columns (driver-side, from df.schema)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
TEMPORAL = "temporal"
OTHER = "other"


def kind_of(dt: T.DataType) -> str:
    # np.number excludes bool, so BooleanType is not numeric
    if isinstance(dt, T.NumericType):
        return NUMERIC
    if isinstance(dt, T.StringType):
        return CATEGORICAL
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TEMPORAL
    return OTHER


def column_kinds(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, kind_of(f.dataType)) for f in df.schema.fields]


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in column_kinds(df) if k == NUMERIC]


def categorical_columns(df: DataFrame) -> list[str]:
    return [c for c, k in column_kinds(df) if k == CATEGORICAL]


def temporal_columns(df: DataFrame) -> list[str]:
    return [c for c, k in column_kinds(df) if k == TEMPORAL]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
