"""Legacy preparation chain.

Data-dependent choices (which columns merge, drop, encode) come from small aggregate
results; the per-row work is column expressions. Encoders join a *bounded* mapping
(<= 50 distinct values by rule) with a broadcast; the unbounded label encoding of a target
uses a distributed dense index (range partitioning + per-partition offsets).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stats import basic_stats, quantiles
from quarry.session import cut_lineage
from quarry.operators.schema import NUMERIC, categorical_columns, column_kinds, numeric_columns

WS = r"[\s\u00A0]"


def distinct_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Exact distinct counts from the value-frequency table (one row per value before the count)."""
    if not cols:
        return {}
    from quarry.operators.profile import value_freq
    got = value_freq(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("d")).collect()
    return {c: 0 for c in cols} | {r["column"]: r["d"] for r in got}


# ---------------------------------------------------------------- F1 / F2 / F3 / F4


def merge_flags(df: DataFrame) -> tuple[DataFrame, dict]:
    """columns with <= 2 distinct values and >= 4 '_' grouped by their first four
    '_'-parts; groups of more than one become {root}_COUNT = sum(Eny/oui -> 1, else 0)."""
    from quarry.operators.profile import few_values
    cand = [c for c in df.columns if c.count("_") >= 4]
    few = few_values(df, cand, 2)
    groups: dict[str, list[str]] = {}
    for c in cand:
        if few[c] is not None:
            groups.setdefault("_".join(c.split("_")[:4]), []).append(c)
    merged = {root: cols for root, cols in groups.items() if len(cols) > 1}
    out = df
    for root, cols in merged.items():
        total = None
        for c in cols:
            v = F.col(f"`{c}`").cast("string")
            term = F.when(v.isin("Eny", "oui", "1"), F.lit(1)).otherwise(F.lit(0))
            total = term if total is None else total + term
        out = out.withColumn(f"{root}_COUNT", total.cast("long"))
    drop = [c for cols in merged.values() for c in cols]
    return out.drop(*drop), merged


def drop_correlated(df: DataFrame, threshold: float = 0.99) -> tuple[DataFrame, list[str]]:
    """numeric columns (nulls as 0) with |r| >= threshold against any *earlier* column
    are dropped (dropped columns still knock out later ones, as in the reference)."""
    nums = numeric_columns(df)
    if len(nums) < 2:
        return df, []
    filled = df.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in nums])
    from quarry.operators.relate import pearson_pairs
    r = {(a, b): v for a, b, _, v in pearson_pairs(filled, nums)}
    drop = [nums[j] for j in range(1, len(nums))
            if any(r.get((nums[i], nums[j])) is not None and abs(r[(nums[i], nums[j])]) >= threshold
                   for i in range(j))]
    return df.drop(*drop), drop


def age_sanity(df: DataFrame, fragments: tuple[str, ...] = ("age", "taona"),
               lo: float = 0, hi: float = 100) -> DataFrame:
    """numeric columns whose name contains a fragment: values outside [lo, hi] -> NULL."""
    out = []
    for c, k in column_kinds(df):
        col = F.col(f"`{c}`")
        if k == NUMERIC and any(f in c.lower() for f in fragments):
            out.append(F.when(col.between(lo, hi) | col.isNull(), col).alias(c))
        else:
            out.append(col)
    return df.select(*out)


def winsorize(df: DataFrame, factor: float = 1.5, min_distinct: int = 11) -> tuple[DataFrame, dict]:
    """numeric columns with > 10 distinct values are clipped to the IQR fences; NULL
    stays NULL (least/greatest would skip it, so the clip is guarded)."""
    nums = numeric_columns(df)
    from quarry.operators.profile import few_values
    cols = [c for c, few in few_values(df, nums, min_distinct - 1).items() if few is None]
    q = quantiles(df, cols, [0.25, 0.75])
    fences = {}
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c in cols:
            q1, q3 = q[c]
            lo, hi = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
            fences[c] = (lo, hi)
            clipped = F.when(col > hi, F.lit(hi)).when(col < lo, F.lit(lo)).otherwise(col.cast("double"))
            out.append(clipped.alias(c))
        else:
            out.append(col)
    return df.select(*out), fences


# ---------------------------------------------------------------- F5 / F6 / F7


def normalize_text(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """strip, lower, collapse whitespace (NBSP included); NULL stays NULL."""
    cols = set(cols if cols is not None else categorical_columns(df))
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c in cols:
            s = F.regexp_replace(col, f"^{WS}+|{WS}+$", "")
            out.append(F.regexp_replace(F.lower(s), f"{WS}+", " ").alias(c))
        else:
            out.append(col)
    return df.select(*out)


DAY_FIRST_FORMATS = ("dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss")


def harmonize_dates(df: DataFrame, fragments: tuple[str, ...] = ("date", "fotoana")) -> DataFrame:
    """string columns named like dates parse day-first; unparsable -> NULL."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType) and any(x in f.name.lower() for x in fragments):
            out.append(F.coalesce(*[F.try_to_timestamp(col, F.lit(fmt)) for fmt in DAY_FIRST_FORMATS])
                       .alias(f.name))
        else:
            out.append(col)
    return df.select(*out)


def impute(df: DataFrame, fill_text: str = "non_defini", exact: bool = True) -> tuple[DataFrame, dict]:
    """numeric NULL -> exact median; string NULL -> 'non_defini'."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    missing = {c for i, c in enumerate(df.columns) if row[f"m{i}"] > 0}
    nums = [c for c in numeric_columns(df) if c in missing]
    med = quantiles(df, nums, [0.5], exact=exact)
    medians = {c: med[c][0] for c in nums}
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if f.name in medians and medians[f.name] is not None:
            out.append(F.coalesce(col.cast("double"), F.lit(medians[f.name])).alias(f.name))
        elif isinstance(f.dataType, T.StringType) and f.name in missing:
            out.append(F.coalesce(col, F.lit(fill_text)).alias(f.name))
        else:
            out.append(col)
    return df.select(*out), medians


# ---------------------------------------------------------------- F8 - F12


def row_index(df: DataFrame, order: "F.Column", out: str = "__idx") -> DataFrame:
    """0-based global position of every row in ``order`` (ties broken arbitrarily but
    deterministically) without a single-partition window: range-partition on the order,
    sort within partitions, read each row's in-partition position from
    monotonically_increasing_id (partition index in the high bits, position in the low
    33 bits), and add the partition's offset from the per-partition counts (P rows)."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    r = (df.withColumn("__o", order).repartitionByRange(parts, "__o").sortWithinPartitions("__o")
         .withColumn("__mid", F.monotonically_increasing_id()))
    r = r.withColumn("__pid", F.shiftright("__mid", 33)).withColumn(
        "__pos", F.col("__mid") - F.shiftleft(F.col("__pid"), 33))
    # positions must come from one materialisation: a recomputed range exchange need not
    # reproduce the same partition layout, so counts and positions are read from one reliable
    # checkpoint in the shared folder (a lost executor cannot force a different layout)
    r = cut_lineage(r)
    counts = {row["__pid"]: row["n"] for row in r.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, acc = [], 0
    for pid in sorted(counts):
        offsets.append((pid, acc))
        acc += counts[pid]
    off = df.sparkSession.createDataFrame(offsets, "__pid long, __off long")
    return (r.join(F.broadcast(off), "__pid").withColumn(out, F.col("__off") + F.col("__pos"))
            .drop("__o", "__mid", "__pid", "__pos", "__off"))


def dense_index(values: DataFrame, col: str, out: str = "code") -> DataFrame:
    """0-based rank of every distinct value of ``col`` in sorted order, computed without a
    single-partition window: range-partition the distinct values, count per partition,
    turn the (few) partition counts into offsets, add the in-partition row number."""
    d = values.select(F.col(f"`{col}`").alias("v")).filter(F.col("v").isNotNull()).distinct()
    parts = max(1, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    r = cut_lineage(d.repartitionByRange(parts, "v").withColumn("pid", F.spark_partition_id()))
    counts = {row["pid"]: row["n"] for row in r.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, acc = [], 0
    for pid in sorted(counts):
        offsets.append((pid, acc))
        acc += counts[pid]
    off = d.sparkSession.createDataFrame(offsets, "pid int, off long")
    w = Window.partitionBy("pid").orderBy("v")
    return (r.withColumn("rn", F.row_number().over(w)).join(F.broadcast(off), "pid")
            .select(F.col("v").alias(col), (F.col("off") + F.col("rn") - 1).alias(out)))


def label_encode(df: DataFrame, col: str, out: str | None = None, null_code: int | None = None,
                 bounded: bool = True, most: int = 10_000) -> DataFrame:
    """code = position of str(value) among the sorted distinct values.
    bounded: the mapping is broadcast if it is found to hold at most ``most`` values; else, and without
    it, the codes are numbered over range partitions and joined."""
    out = out or col
    s = df.withColumn("__s", F.col(f"`{col}`").cast("string"))
    few = s.select("__s").filter(F.col("__s").isNotNull()).distinct().limit(most + 1).collect() if bounded else []
    if bounded and len(few) <= most:
        codes = [(v, i) for i, v in enumerate(sorted((r[0] for r in few), key=lambda x: x.encode()))]
        mapping = F.broadcast(df.sparkSession.createDataFrame(codes, "__s string, __code long"))
    else:
        mapping = dense_index(s, "__s", "__code")
    j = s.join(mapping, "__s", "left")
    code = F.col("__code") if null_code is None else F.coalesce(F.col("__code"), F.lit(null_code))
    cols = [code.cast("long").alias(out) if c == col else F.col(f"`{c}`") for c in df.columns]
    if out != col:
        cols = [F.col(f"`{c}`") for c in df.columns] + [code.cast("long").alias(out)]
    return j.select(*cols)


def label_codes(df: DataFrame, col: str, values: list[str], out: str | None = None, null_code: int | None = None) -> DataFrame:
    """``label_encode`` where the values are known and few: a projection, no job and no join."""
    out = out or col
    v = F.col(f"`{col}`").cast("string")
    code = F.array_position(F.array(*[F.lit(x) for x in values]), v) - 1 if values else F.lit(None)
    code = F.when(v.isNotNull(), code) if null_code is None else F.when(v.isNull(), F.lit(null_code)).otherwise(code)
    cols = [code.cast("long").alias(c) if c == out == col else F.col(f"`{c}`") for c in df.columns]
    return df.select(*cols, *([code.cast("long").alias(out)] if out != col else []))


def one_hot(df: DataFrame, col: str, values: list[str], prefix: str | None = None,
            as_int: bool = False, drop: bool = True) -> DataFrame:
    """One indicator column per listed value, {prefix}_{value}; NULL -> all false / 0."""
    prefix = prefix if prefix is not None else col
    v = F.col(f"`{col}`").cast("string")
    ind = [F.coalesce(v == F.lit(x), F.lit(False)) for x in values]
    ind = [(i.cast("int") if as_int else i).alias(f"{prefix}_{x}") for i, x in zip(ind, values)]
    keep = [F.col(f"`{c}`") for c in df.columns if not (drop and c == col)]
    return df.select(*keep, *ind)


def minmax_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - min) / (max - min) for the listed columns when max > min."""
    bs = basic_stats(df, cols)
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c in cols and bs[c]["max"] is not None and bs[c]["max"] > bs[c]["min"]:
            lo, hi = bs[c]["min"], bs[c]["max"]
            out.append(((col.cast("double") - F.lit(lo)) / F.lit(hi - lo)).alias(c))
        else:
            out.append(col)
    return df.select(*out)


def process_features(df: DataFrame, target: str) -> tuple[DataFrame, dict]:
    """F1 -> F2 -> F3 -> F4 -> F5/F6 -> F7 -> encode (target label-encoded; strings
    <= 5 distinct one-hot, 6..50 label-encoded, > 50 dropped) -> F12 min-max on numerics
    with > 2 distinct values (target untouched). Returns (df, report)."""
    report = {}
    df, report["merged"] = merge_flags(df)
    df, report["dropped_correlated"] = drop_correlated(df)
    df = age_sanity(df)
    df, report["winsorized"] = winsorize(df)
    df = harmonize_dates(normalize_text(df))
    df, report["medians"] = impute(df)
    kinds = dict(column_kinds(df))
    from quarry.operators.profile import few_values
    strings = [c for c, k in kinds.items() if k == "categorical"]
    few = few_values(df, df.columns, 50)  # all that the rules below ask for, in one pass
    report["encoding"] = {}
    for c in list(df.columns):
        if c == target:
            if kinds.get(c) == "categorical":
                df = label_encode(df, c, bounded=False) if few[c] is None else label_codes(df, c, few[c])
                report["encoding"][c] = "target_label"
            continue
        if c in strings:
            if few[c] is None:
                df = df.drop(c)
                report["encoding"][c] = "dropped"
            elif len(few[c]) <= 5:
                df = one_hot(df, c, few[c])
                report["encoding"][c] = "one_hot"
            else:
                df = label_codes(df, c, few[c])
                report["encoding"][c] = "label"
    scale = [c for c in numeric_columns(df) if c != target and c in few and (few[c] is None or len(few[c]) > 2)]
    df = minmax_scale(df, scale)
    report["scaled"] = scale
    return df, report
