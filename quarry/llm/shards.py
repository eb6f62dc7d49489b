"""Range shards of equal weight, and shard files in the shared folder.

Shard bounds come from histograms of the key alone (counted by Spark, 16,384 bins at a time), so they
are the same on every run; bins that hold too much are cut again. Files are written under a temporary
name and renamed, so that a task that is run again leaves one whole copy of the same content."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1 << 14
#: Most shards of one run (the tables of bounds and totals have this size).
MOST_SHARDS = 4096


def range_bounds(df: DataFrame, key: str, weight: Column, share: float) -> list[int]:
    """Ascending bounds such that the rows with bound[i - 1] <= key < bound[i] weigh about ``share``.
    Nulls belong before all bounds. ``key`` is a whole number."""
    slim = df.select(F.col(key).alias("k"), F.coalesce(weight, F.lit(0)).cast("long").alias("w")).filter("k is not null")
    lo, hi, total = slim.agg(F.min("k"), F.max("k"), F.sum("w")).first()
    if lo is None or not total:
        return []
    share = max(share, total / MOST_SHARDS)
    pieces: list[tuple[int, int, int]] = []  # (first key, past the last, weight)
    open_ = [(lo, hi + 1)]
    for _ in range(8):
        if not open_:
            break
        expr, wide = None, {}
        for i, (a, b) in enumerate(open_):
            wide[i] = step = -(-(b - a) // BINS)
            wide_k = F.col("k").cast("decimal(38,0)")  # the difference of two longs may not be one
            one = F.struct(F.lit(i).alias("i"), F.floor((wide_k - F.lit(a)) / F.lit(step).cast("decimal(20,0)")).cast("long").alias("bin"))
            cond = (F.col("k") >= a) & (F.col("k") <= b - 1)
            expr = F.when(cond, one) if expr is None else expr.when(cond, one)
        rows = slim.withColumn("at", expr).filter("at is not null").groupBy("at.i", "at.bin").agg(F.sum("w").alias("w")).collect()
        again = []
        for r in rows:
            (lo, hi), step = open_[r["i"]], wide[r["i"]]
            a, b = lo + r["bin"] * step, min(lo + (r["bin"] + 1) * step, hi)
            if r["w"] > share and b - a > 1:
                again.append((a, b))
            else:
                pieces.append((a, b, r["w"]))
        open_ = sorted(again)
    pieces += [(a, b, 0) for a, b in open_]
    bounds, acc = [], 0
    for a, _, w in sorted(pieces):
        if acc and acc + w > share:
            bounds.append(a)
            acc = 0
        acc += w
    return bounds


def shard_of(key: str, bounds: list[int], nulls_last: bool = False) -> Column:
    """Number of bounds at or below the key, as a balanced tree of conditions. Nulls go to the first
    shard or to the last."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))
    return F.when(F.col(key).isNull(), F.lit(len(bounds) if nulls_last else 0)).otherwise(tree(0, len(bounds))).cast("int") if bounds else F.lit(0)


def filesystem(path: str):
    """(pyarrow file system, path within it) of a shared folder: local mounts and remote stores alike."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def commit_file(folder: str, name: str, chunks) -> int:
    """Write ``chunks`` as folder/name: first under a temporary name, then renamed. Returns the size."""
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    temporary = f"{base}/_{name}.{os.getpid()}.{uuid.uuid4().hex}.tmp"
    size = 0
    with fs.open_output_stream(temporary, compression=None) as out:
        for c in chunks:
            out.write(c)
            size += len(c)
    fs.move(temporary, f"{base}/{name}")
    return size
