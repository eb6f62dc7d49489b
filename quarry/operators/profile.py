"""One-pass profiling: univariate statistics, frequencies, histograms, missingness, quality.

Design: every statistic over rows is a Spark aggregate. The per-column results are tiny
(one row per column) and are the only thing that reaches the driver, where the next stage's
literals (quartiles, bin edges) are read from them.  Two shared intermediates:

* ``value_freq``  -- unpivot + groupBy(column, value).count(): one shuffle with map-side
  partial aggregation; gives distinct counts, modes, top-k, pies and encoders.
* ``column_profile`` -- one row per column with kind, counts and moments.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stats import (basic_stats, central_sums, finite, freq_central_sums, freq_stats,
                                    moments_from_sums, quantiles)
from quarry.operators.heavy import modes
from quarry.operators.schema import (CATEGORICAL, NUMERIC, TEMPORAL, categorical_columns,
                                     column_kinds, numeric_columns)

# ---------------------------------------------------------------- shared intermediates


def value_freq(df: DataFrame, cols: list[str], value_type: str = "string",
               keep_null: bool = False) -> DataFrame:
    """(column, value, n): frequency of every value of every listed column.

    One Expand + hash aggregate; partial aggregation happens before the shuffle, so a hot
    value costs one row per map task, not one row per occurrence."""
    if not cols:
        schema = f"column string, value {value_type}, n long"
        return df.sparkSession.createDataFrame([], schema)
    cast = lambda c: finite(F.col(c)) if value_type == "double" else F.col(c).cast(value_type)
    casted = spread(df.select(*[cast(c).alias(c) for c in cols]))
    long = casted.unpivot([], cols, "column", "value")
    if not keep_null:
        long = long.filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def few_values(df: DataFrame, cols: list[str], most: int) -> dict[str, list[str] | None]:
    """The distinct non-null values of each column as strings, in byte order, or None for a column with more than ``most``.

    One pass for all columns. A task keeps at most ``most`` + 1 values a column and stops looking at a column
    once it has them, so a column of unique values costs (tasks x most) rows of shuffle and not its rows: whoever
    asks for few values does not pay for the many. No value is missed: a column within the limit is within it in
    every task."""
    import pyarrow as pa
    import pyarrow.compute as pc
    if not cols:
        return {}
    names = [f"c{i}" for i in range(len(cols))]

    def bounded(batches):
        held: list[set] = [set() for _ in names]
        for batch in batches:
            for own, column in zip(held, batch.columns):
                if len(own) <= most:
                    for v in pc.unique(column.drop_null()).to_pylist():
                        own.add(v)
                        if len(own) > most:
                            break
        at = [i for i, own in enumerate(held) for _ in own]
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()),
                                          "value": pa.array([v for own in held for v in own], pa.string())})

    text = df.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(cols, names)])
    w = Window.partitionBy("at").orderBy("value")
    rows = (text.mapInArrow(bounded, "at int, value string").dropDuplicates()
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most + 1).collect())
    found: list[list[str]] = [[] for _ in cols]
    for r in rows:
        found[r["at"]].append(r["value"])
    return {c: sorted(v, key=str.encode) if len(v) <= most else None for c, v in zip(cols, found)}


def spread(df: DataFrame) -> DataFrame:
    """The input dealt over ``spark.quarry.inputPartitions`` partitions, where the session sets that:
    for single small files on one machine, whose row groups cannot be split. Unset on a cluster, where
    the split size (spark.sql.files.maxPartitionBytes) rules and nothing is shuffled."""
    n = df.sparkSession.conf.get("spark.quarry.inputPartitions", None)
    return df.repartition(int(n)) if n else df


def mode_per_column(vf: DataFrame) -> DataFrame:
    """Most frequent value per column, ties to the smallest value (pandas mode()[0])."""
    return vf.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("nn"), F.col("value").alias("v")))
        .alias("mode"))


def top_k_per_column(vf: DataFrame, k: int, rank_col: str = "rank") -> DataFrame:
    """Top-k values per column by count desc, value asc.

    row_number + filter is planned as a WindowGroupLimit on both sides of the shuffle, so
    each map task forwards only k rows per column even for a column with millions of
    distinct values."""
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
    return vf.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


# ---------------------------------------------------------------- U1 / U2 / U5


NUMERIC_SUMMARY_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()), T.StructField("ordinal", T.LongType()),
    T.StructField("count", T.LongType()), T.StructField("missing", T.LongType()),
    T.StructField("missing_pct", T.DoubleType()), T.StructField("mean", T.DoubleType()),
    T.StructField("median", T.DoubleType()), T.StructField("mode", T.DoubleType()),
    T.StructField("std", T.DoubleType()), T.StructField("var", T.DoubleType()),
    T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType()),
    T.StructField("q1", T.DoubleType()), T.StructField("q3", T.DoubleType()),
    T.StructField("iqr", T.DoubleType()), T.StructField("skew", T.DoubleType()),
    T.StructField("kurtosis", T.DoubleType()), T.StructField("cv", T.DoubleType()),
    T.StructField("outliers", T.LongType()), T.StructField("lower_fence", T.DoubleType()),
    T.StructField("upper_fence", T.DoubleType()),
])


def numeric_stats(df: DataFrame, cols: list[str] | None = None, exact: bool = True,
                  with_mode: bool = True, with_outliers: bool = True) -> list[dict]:
    """U1 + U2 + U5 as a list of small dicts (one per column with >= 2 values).

    with_mode: a bounded counter summary (``heavy.modes``) comes first. Columns that it knows whole are computed from
    its frequencies; of columns whose mode it proves, the rest comes from scans, as without mode; only what is left (rare
    modes) is aggregated into value_freq, where all values meet. Every statistic of a column with frequencies is a
    weighted aggregate over them.
    without mode: count/sum/min/max scan -> quantile refinement -> one scan for central
    moments fused with the outlier count. All aggregates are code-generated."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return []
    vf, counted, found = None, [], None
    if with_mode:
        found = modes(df, cols)
        counted = [c for c in cols if c in found.whole or c in found.rest]
    scanned = [c for c in cols if c not in counted]
    bs = {}
    if scanned:
        bs |= basic_stats(df, scanned)
    if counted:
        vf = found.freq
        if found.rest:
            vf = vf.unionByName(value_freq(df, found.rest, "double"))
        vf = vf.persist()
        bs |= freq_stats(vf, counted, found.rows)
    rows_total = bs["__rows"]
    by_scan, by_freq = ([c for c in some if bs[c]["n"] >= 2] for some in (scanned, counted))
    keep = [c for c in cols if bs[c]["n"] >= 2]
    probs = [0.25, 0.5, 0.75]
    q = quantiles(df, by_scan, probs, stats=bs, exact=exact) | quantiles(df, by_freq, probs, stats=bs, exact=exact, freq=vf)
    fences = {c: (q[c][0] - 1.5 * (q[c][2] - q[c][0]), q[c][2] + 1.5 * (q[c][2] - q[c][0])) for c in keep}
    means = {c: bs[c]["mean"] for c in keep}
    cs: dict[str, dict] = {}
    if by_freq:
        got = freq_central_sums(vf, by_freq, means, {c: fences[c] for c in by_freq} if with_outliers else None)
        cs |= {c: {"out": got.get(f"out_{c}")} | {m: got[f"{m}_{i}"] for m in ("m2", "m3", "m4")} for i, c in enumerate(by_freq)}
    if by_scan:
        x = {c: finite(F.col(f"`{c}`")) for c in by_scan}
        extra = [F.count_if((x[c] < F.lit(fences[c][0])) | (x[c] > F.lit(fences[c][1]))).alias(f"out_{i}")
                 for i, c in enumerate(by_scan)] if with_outliers else []
        got = central_sums(df, by_scan, means, extra)
        cs |= {c: {"out": got.get(f"out_{i}")} | {m: got[f"{m}_{i}"] for m in ("m2", "m3", "m4")} for i, c in enumerate(by_scan)}
    modal = {c: found.known.get(c, bs[c].get("mode")) for c in keep} if with_mode else {}
    if vf is not None:
        vf.unpersist()
    if found is not None:
        found.release()
    stats = []
    for c in keep:
        n = bs[c]["n"]
        mom = moments_from_sums(n, cs[c]["m2"], cs[c]["m3"], cs[c]["m4"])
        q1, med, q3 = q[c]
        mean, sd = bs[c]["mean"], mom["sd"]
        cv = (sd / (abs(mean) + 1e-6)) if (mean not in (None, 0) and sd is not None) else 0.0
        stats.append({
            "column": c, "ordinal": cols.index(c), "count": n, "missing": rows_total - n,
            "missing_pct": 100.0 * (rows_total - n) / rows_total if rows_total else 0.0,
            "mean": mean, "median": med, "mode": modal.get(c), "std": sd, "var": mom["var"],
            "min": bs[c]["min"], "max": bs[c]["max"], "q1": q1, "q3": q3, "iqr": q3 - q1,
            "skew": mom["skew"], "kurtosis": mom["kurt"], "cv": cv,
            "outliers": cs[c]["out"] if with_outliers else None,
            "lower_fence": fences[c][0], "upper_fence": fences[c][1],
        })
    return stats


def numeric_summary(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """U1/U2/U5 long table: one row per numeric column."""
    stats = numeric_stats(df, cols, exact=exact)
    return df.sparkSession.createDataFrame(
        [tuple(s[f.name] for f in NUMERIC_SUMMARY_SCHEMA.fields) for s in stats],
        NUMERIC_SUMMARY_SCHEMA)


# ---------------------------------------------------------------- U3 / P14


def categorical_summary(df: DataFrame, cols: list[str] | None = None,
                        vf: DataFrame | None = None) -> DataFrame:
    """Unique, missing, missing_pct, top category, cardinality ratio per column."""
    cols = list(cols) if cols is not None else categorical_columns(df)
    spark = df.sparkSession
    crow = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    rows_total = crow["__rows"]
    counts = spark.createDataFrame(
        [(c, i, crow[f"n{i}"]) for i, c in enumerate(cols)],
        "column string, ordinal long, non_null long")
    vf = vf if vf is not None else value_freq(df, cols)
    per = vf.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct((-F.col("n")).alias("nn"), F.col("value").alias("v")))
        .alias("top_category"))
    rows = F.lit(rows_total).cast("double")
    return (F.broadcast(counts).join(per, "column", "left")
            .select("column", "ordinal",
                    F.coalesce("unique", F.lit(0)).cast("long").alias("unique"),
                    (F.lit(rows_total) - F.col("non_null")).cast("long").alias("missing"),
                    (F.lit(100.0) * (F.lit(rows_total) - F.col("non_null")) / rows)
                    .alias("missing_pct"),
                    "top_category",
                    (F.coalesce("unique", F.lit(0)) / rows).alias("cardinality_ratio")))


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 10) -> DataFrame:
    """U3 top-k: (column, rank, value, n) ordered by n desc, value asc."""
    cols = list(cols) if cols is not None else categorical_columns(df)
    return top_k_per_column(value_freq(df, cols), k).select("column", "rank", "value", "n")


def category_samples(df: DataFrame, cols: list[str] | None = None, k: int = 3,
                     max_columns: int | None = None, width: int = 50) -> DataFrame:
    """First ``max_columns`` columns, ``k`` smallest distinct non-null values, ``width`` chars."""
    cols = (list(cols) if cols is not None else df.columns)[:max_columns]
    vf = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
          .unpivot([], cols, "column", "value").filter(F.col("value").isNotNull())
          .groupBy("column", "value").agg(F.lit(1).alias("n")))
    w = Window.partitionBy("column").orderBy("value")
    return (vf.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("column", "rank", F.substring("value", 1, width).alias("sample")))


# ---------------------------------------------------------------- U4 / U6


def histogram(df: DataFrame, cols: list[str] | None = None, max_bins: int = 30,
              max_columns: int | None = None, min_values: int = 3) -> DataFrame:
    """U4: equal-width bins (min(max_bins, floor(sqrt(n)))), last bin closed; empty bins kept.

    Output (column, bin, lo, hi, n, pct)."""
    cols = (list(cols) if cols is not None else numeric_columns(df))[:max_columns]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, bin int, lo double, hi double, n long, pct double")
    srow = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
                  *[F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(cols)],
                  *[F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    spec = []
    for i, c in enumerate(cols):
        n = srow[f"n{i}"]
        if n < min_values:
            continue
        spec.append((c, int(min(max_bins, int(math.isqrt(n)))), srow[f"lo{i}"], srow[f"hi{i}"], n))
    if not spec:
        return spark.createDataFrame([], "column string, bin int, lo double, hi double, n long, pct double")
    bins = (spark.createDataFrame(spec, "column string, nbins int, cmin double, cmax double, total long")
            .withColumn("bin", F.explode(F.sequence(F.lit(1), F.col("nbins")))))
    parts = []
    for c, nb, lo, hi, _ in spec:
        x = F.col(c).cast("double")
        if hi > lo:
            b = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(nb)) + 1, F.lit(nb))
        else:  # numpy widens a degenerate range to [v-0.5, v+0.5]; the single value lands mid
            b = F.lit(nb // 2 + 1)
        parts.append(F.when(x.isNotNull(), F.struct(F.lit(c).alias("column"), b.cast("int").alias("bin"))))
    counts = (df.select(F.explode(F.filter(F.array(*parts), lambda s: s.isNotNull())).alias("s"))
              .groupBy("s.column", "s.bin").agg(F.count(F.lit(1)).alias("n")))
    width = F.when(F.col("cmax") > F.col("cmin"), (F.col("cmax") - F.col("cmin")) / F.col("nbins"))
    lo_edge = F.when(width.isNotNull(), F.col("cmin") + (F.col("bin") - 1) * width) \
        .otherwise(F.col("cmin") - 0.5 + (F.col("bin") - 1) / F.col("nbins"))
    hi_edge = F.when(width.isNotNull(), F.col("cmin") + F.col("bin") * width) \
        .otherwise(F.col("cmin") - 0.5 + F.col("bin") / F.col("nbins"))
    return (F.broadcast(bins).join(counts, ["column", "bin"], "left")
            .select("column", "bin", lo_edge.alias("lo"), hi_edge.alias("hi"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                    (F.lit(100.0) * F.coalesce("n", F.lit(0)) / F.col("total")).alias("pct")))


def pie(df: DataFrame, cols: list[str] | None = None, max_columns: int | None = None,
        min_distinct: int = 2, max_distinct: int = 10, name_width: int = 50) -> DataFrame:
    """Value shares of the categoricals with 2..10 distinct values."""
    cols = (list(cols) if cols is not None else categorical_columns(df))[:max_columns]
    vf = value_freq(df, cols)
    # per-column totals as an aggregate (k rows, broadcast), not a window over every
    # distinct value of a column
    tot = vf.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("total"))
    return (vf.join(F.broadcast(tot.filter(F.col("distinct").between(min_distinct, max_distinct))), "column")
            .select("column", F.substring("value", 1, name_width).alias("name"),
                    F.col("n").alias("value"), F.col("total").cast("long").alias("total"),
                    (F.lit(100.0) * F.col("n") / F.col("total")).alias("pct")))


# ---------------------------------------------------------------- P9 / P10 / P11 / P22


def missing_counts(df: DataFrame, cols: list[str] | None = None) -> tuple[int, list[tuple[str, int]]]:
    cols = list(cols) if cols is not None else df.columns
    row = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return row["__rows"], [(c, row[f"m{i}"]) for i, c in enumerate(cols)]


def missing_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, ordinal, missing, pct, status) with status empty / partial / complete."""
    rows, miss = missing_counts(df, cols)
    data = []
    for i, (c, m) in enumerate(miss):
        pct = 100.0 * m / rows if rows else 0.0
        status = "empty" if rows and m == rows else ("partial" if m > 0 else "complete")
        data.append((c, i, m, pct, status))
    return df.sparkSession.createDataFrame(
        data, "column string, ordinal long, missing long, pct double, status string")


def data_quality(df: DataFrame) -> DataFrame:
    """P10 + P22: total missing cells, cell-based completeness and its band."""
    rows, miss = missing_counts(df)
    ncols = len(miss)
    total_missing = sum(m for _, m in miss)
    cells = rows * ncols
    missing_ratio = total_missing / cells if cells else 0.0
    completeness = 100.0 * (1 - missing_ratio)
    # The names of the bands.
    band = ("excellente" if completeness >= 95 else "bonne" if completeness >= 85 else
            "acceptable" if completeness >= 70 else "moyenne" if completeness >= 50 else "faible")
    return df.sparkSession.createDataFrame(
        [(rows, ncols, total_missing, 100.0 * missing_ratio, completeness, band)],
        "rows long, columns long, total_missing long, missing_pct double, "
        "completeness double, quality string")


# Theme keywords for column tagging (P16), first match wins, rest "Autres".
THEME_KEYWORDS = [
    ("Démographie", ["age", "genre", "sexe", "region"]),
    ("Économie", ["revenu", "argent", "budget", "salaire"]),
    ("Activité", ["metier", "job", "activité"]),
    ("Tech", ["tel", "phone", "electricite"]),
    ("Temporel", ["date", "annee", "mois"]),
]


def theme_of(name: str) -> str:
    low = name.lower()
    for theme, words in THEME_KEYWORDS:
        if any(w in low for w in words):
            return theme
    return "Autres"


def column_profile(df: DataFrame, stage: str = "raw", exact: bool = True, with_quantiles: bool = True) -> DataFrame:
    """P11/P13/P16 + the shared profile: one row per column.

    (stage, column, ordinal, kind, theme, n, n_null, n_distinct, mean, sd, var, min, max,
     q1, median, q3, skew, kurt)

    with_quantiles=False skips the quantile rounds (selection rules do not read them)."""
    spark = df.sparkSession
    kinds = column_kinds(df)
    cols = [c for c, _ in kinds]
    nums = [c for c, k in kinds if k == NUMERIC]
    # one scan: counts of every column, sum / min / max of the numerics
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        aggs.append(F.count(finite(F.col(f"`{c}`")) if c in nums else F.col(f"`{c}`")).alias(f"n{i}"))
    for j, c in enumerate(nums):
        x = finite(F.col(f"`{c}`"))
        aggs += [F.sum(x).alias(f"s{j}"), F.min(x).alias(f"lo{j}"), F.max(x).alias(f"hi{j}")]
    crow = df.agg(*aggs).first()
    rows = crow["__rows"]
    bs = {"__rows": rows}
    for j, c in enumerate(nums):
        n = crow[f"n{cols.index(c)}"]
        bs[c] = {"n": n, "sum": crow[f"s{j}"], "min": crow[f"lo{j}"], "max": crow[f"hi{j}"],
                 "mean": (crow[f"s{j}"] / n) if n else None}
    q = (quantiles(df, [c for c in nums if bs[c]["n"] > 0], [0.25, 0.5, 0.75], stats=bs, exact=exact)
         if with_quantiles else {})
    cs = central_sums(df, nums, {c: bs[c]["mean"] for c in nums})
    distinct = {r["column"]: r["d"] for r in
                value_freq(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("d")).collect()}
    data = []
    for i, (c, k) in enumerate(kinds):
        n = crow[f"n{i}"]
        if c in nums:
            j = nums.index(c)
            mom = moments_from_sums(n, cs[f"m2_{j}"], cs[f"m3_{j}"], cs[f"m4_{j}"])
            qq = q.get(c, [None, None, None])
            num_part = (bs[c]["mean"], mom["sd"], mom["var"], bs[c]["min"], bs[c]["max"],
                        qq[0], qq[1], qq[2], mom["skew"], mom["kurt"])
        else:
            num_part = (None,) * 10
        data.append((stage, c, i, k, theme_of(c), n, rows - n, distinct.get(c, 0)) + num_part)
    return spark.createDataFrame(
        data, "stage string, column string, ordinal long, kind string, theme string, n long, "
              "n_null long, n_distinct long, mean double, sd double, var double, min double, "
              "max double, q1 double, median double, q3 double, skew double, kurt double")


# ---------------------------------------------------------------- U7 / U8


def scatter_sample(df: DataFrame, target: str, cols: list[str], key: str,
                   max_points: int = 500, max_pairs: int | None = None, min_pairs: int = 5) -> DataFrame:
    """Per (target, var) pair, the complete rows of the <= max_points least md5 of (var, key),
    ranked in that order, plus the correlation of that sample. A sampling operator: the limit is
    the feature. (var, key, x, y, rank, sample_r)"""
    others = [c for c in cols if c != target][:max_pairs]
    spark = df.sparkSession
    if not others:
        return spark.createDataFrame([], "var string, key long, x double, y double, rank int, sample_r double")
    parts = [F.when(F.col(c).isNotNull() & F.col(target).isNotNull(),
                    F.struct(F.lit(c).alias("var"), F.col(c).cast("double").alias("x")))
             for c in others]
    long = (df.select(F.col(key).alias("key"), F.col(target).cast("double").alias("y"),
                      F.explode(F.filter(F.array(*parts), lambda s: s.isNotNull())).alias("s"))
            .select("s.var", "key", "s.x", "y")
            .withColumn("h", F.md5(F.concat_ws("|", F.col("var"), F.col("key").cast("string")))))
    w = Window.partitionBy("var").orderBy("h", "key")
    sampled = long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_points)
    pw = Window.partitionBy("var")
    sampled = (sampled.withColumn("cnt", F.count(F.lit(1)).over(pw))
               .filter(F.col("cnt") >= min_pairs)
               .withColumn("sample_r", F.corr("x", "y").over(pw)))
    return sampled.select("var", "key", "x", "y", "rank", "sample_r")


#: Patterns that a text may have as a date, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy", "MM/dd/yyyy")


#: What the fields of a pattern may look like at most.
_DATE_FIELDS = {"yyyy": r"[+-]?[0-9]{4,}", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "HH": "[0-9]{2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}"}


def parsed_date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The timestamp of a text by the first pattern that parses it, else null. Texts without the shape of a pattern
    are not tried: a failed parse costs some ten microseconds, which a column of words would pay for every row and pattern."""
    def tried(fmt):
        stamp = F.try_to_timestamp(text, F.lit(fmt))
        parts = re.split(r"([A-Za-z]+)", fmt)
        if any(p not in _DATE_FIELDS for p in parts[1::2]):
            return stamp
        shape = "".join(_DATE_FIELDS[p] if i % 2 else re.escape(p) for i, p in enumerate(parts))
        return F.when(text.rlike(f"^{shape}$"), stamp)
    return F.coalesce(*[tried(f) for f in formats])


def date_columns(df: DataFrame, cols: list[str] | None = None,
                 threshold: float = 0.8, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """U8: temporal-typed columns, plus string columns of whose non-null values more than
    ``threshold`` parse as dates; one aggregate over all string columns and rows.
    (column, kind, parsed_share, is_date)"""
    kinds = [(c, k) for c, k in column_kinds(df) if cols is None or c in cols]
    strings = [c for c, k in kinds if k == CATEGORICAL]
    share = {}
    if strings:
        aggs = []
        for i, c in enumerate(strings):
            v = F.col(f"`{c}`")
            parsed = parsed_date(v, formats)
            aggs.append(F.avg(F.when(v.isNotNull(), parsed.isNotNull().cast("double"))).alias(f"s{i}"))
        row = df.agg(*aggs).first()
        share = {c: row[f"s{i}"] or 0.0 for i, c in enumerate(strings)}
    out = [(c, k, 1.0 if k == TEMPORAL else share[c], k == TEMPORAL or share[c] > threshold)
           for c, k in kinds if k == TEMPORAL or c in share]
    return df.sparkSession.createDataFrame(out, "column string, kind string, parsed_share double, is_date boolean")
