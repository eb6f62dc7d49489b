"""Preview rows with an explicit order (never positional), datetimes formatted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def preview(df: DataFrame, key: str, n: int = 500, ts_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """First ``n`` rows by ``key`` (a top-k: TakeOrderedAndProject keeps n rows per task),
    timestamps rendered as text, NaN shown as NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out.append(F.date_format(c, ts_format).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(~F.isnan(c), c).alias(f.name))
        else:
            out.append(c)
    return df.orderBy(key).limit(n).select(*out)
