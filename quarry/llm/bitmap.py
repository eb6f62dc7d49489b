"""A sieve over keys: a table of bitmaps of fixed size, small enough to broadcast whatever the data.

Keys are hashed to ``1 << BITS`` positions, so the sieve is at most ``2^(BITS - 3)`` bytes (2 MB). A row
that fails it has none of the keys; one that passes may still have none, and a join decides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24
_BUCKET = 32768  # positions in one bitmap of bitmap_construct_agg


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << BITS))


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """(sieve_part, sieve_bits) of the distinct keys."""
    return (keys.select(_place(key).alias("p")).distinct()
            .groupBy(F.floor(F.col("p") / _BUCKET).cast("int").alias("sieve_part"))
            .agg(F.bitmap_construct_agg(F.pmod("p", F.lit(_BUCKET))).alias("sieve_bits")))


def sieved(rows: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """``rows`` with ``may_have``: false where the key is certainly not among the sieve's."""
    at = F.pmod(_place(key), F.lit(_BUCKET)).cast("int")
    return (rows.withColumn("sieve_part", F.floor(_place(key) / _BUCKET).cast("int")).withColumn("sieve_at", at)
            .join(F.broadcast(of), "sieve_part", "left")
            .withColumn("may_have", F.coalesce(F.expr(
                "(cast(conv(hex(substring(sieve_bits, sieve_at div 8 + 1, 1)), 16, 10) as int)"
                " div cast(power(2, sieve_at % 8) as int)) % 2 = 1"), F.lit(False)))
            .drop("sieve_part", "sieve_bits", "sieve_at"))


def low_bits(keys: DataFrame, key: str) -> np.ndarray:
    """The same bitmap for tasks' own use, over the low bits of keys that are hashes already: 2 MB on the driver."""
    place = F.col(key).bitwiseAND((1 << BITS) - 1)
    parts = (keys.select(place.alias("p")).distinct().groupBy(F.shiftright("p", 15).alias("part"))
             .agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(_BUCKET - 1)).alias("bits")))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in parts.collect():
        bits = np.frombuffer(r["bits"], np.uint8)
        out[r["part"] * _BUCKET // 8:][:len(bits)] = bits
    return out


def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of the unsigned 64-bit keys may be in the bitmap."""
    place = (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
