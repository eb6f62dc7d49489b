"""Query registry and result normalisation shared by Spark queries and their DuckDB oracles.

Doubles are rounded to 11 significant digits on both sides with the same arithmetic
(multiply / divide by an exact power of ten, round, undo), so results computed with a
different summation order hash identically.  Integers leave as BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

SIG_DIGITS = 11


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# Exact decimal results (interpolated quartiles, means of cent amounts) often sit exactly on
# a rounding tie, where one-ulp differences between engines would round apart. Scaling by
# (1 + NUDGE) first moves every value near such a tie to the same side; the new boundary is
# no longer an exact decimal, and NUDGE is far above ulp noise and far below the grid.
NUDGE = "1.0000000000001"


def sig(c: Column, digits: int = SIG_DIGITS) -> Column:
    raw = c.cast("double")
    x = raw * F.lit(float(NUDGE))
    e = F.floor(F.log10(F.abs(x)))
    k = F.lit(digits - 1) - e
    up = F.round(x * F.pow(F.lit(10.0), k), 0) / F.pow(F.lit(10.0), k)
    down = F.round(x / F.pow(F.lit(10.0), -k), 0) * F.pow(F.lit(10.0), -k)
    r = F.when(k >= 0, up).otherwise(down)
    return (F.when(raw.isNull() | F.isnan(raw), raw).when(raw == 0, F.lit(0.0))
            .when(F.abs(raw) == float("inf"), raw).otherwise(r) + F.lit(0.0))


def finish(df: DataFrame, digits: int = SIG_DIGITS) -> DataFrame:
    """Normalise a result for comparison: doubles to ``digits`` significant digits (fewer for
    columns that are differences of large nearly-equal numbers), ints to long."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(sig(F.col(f"`{f.name}`"), digits).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(F.col(f"`{f.name}`").cast("long").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def sig_sql(expr: str, digits: int = SIG_DIGITS) -> str:
    raw = f"CAST({expr} AS DOUBLE)"
    x = f"({raw} * CAST({NUDGE} AS DOUBLE))"
    k = f"({digits - 1} - floor(log10(abs({x}))))"
    return (f"(CASE WHEN {raw} IS NULL OR isnan({raw}) THEN {raw} WHEN {raw} = 0 THEN 0.0::DOUBLE "
            f"WHEN isinf({raw}) THEN {raw} "
            f"WHEN {k} >= 0 THEN round({x} * pow(10.0, {k})) / pow(10.0, {k}) "
            f"ELSE round({x} / pow(10.0, -{k})) * pow(10.0, -{k}) END + 0.0)")


def oracle_finish(sql: str, doubles: list[str] = (), ints: list[str] = (), digits: int = SIG_DIGITS) -> str:
    """Wrap an oracle query so its doubles / ints are normalised like ``finish``."""
    reps = [f"{sig_sql(c, digits)} AS {c}" for c in doubles] + [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
    if not reps:
        return sql
    return f"SELECT * REPLACE ({', '.join(reps)}) FROM (\n{sql}\n) AS _q"
