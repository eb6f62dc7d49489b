"""Feature forge.

* G4 group means are a groupBy + broadcast join of the (<= 30 groups by rule) mean table,
  not a window partitioned by the category: a hot category would put a third of the rows
  into one window task, while the aggregate combines map-side.
* Scalers are column expressions over statistics from one profile pass (no Python).
* PCA is Spark ML (distributed covariance, k x k on the driver).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stats import basic_stats, central_sums, moments_from_sums, quantiles
from quarry.operators.prepare import distinct_counts, label_codes, one_hot
from quarry.operators.profile import column_profile, few_values
from quarry.operators.schema import categorical_columns, numeric_columns, temporal_columns
from quarry.operators.select import interaction_candidates


def _alnum(name: str, n: int) -> str:
    return re.sub(r"[^a-zA-Z0-9]", "", name)[:n]


# ---------------------------------------------------------------- G1


def temporal_features(df: DataFrame, cols: list[str] | None = None, as_of: str = "2025-01-01",
                      max_columns: int | None = None, min_values: int = 10) -> tuple[DataFrame, list[dict]]:
    """G1: per date column (>= 10 parsed values): {base}_annee, _mois, _jour_semaine
    (Mon=0), _is_weekend (null -> 0), _anciennete_jours (days from the date to ``as_of``)."""
    cols = (list(cols) if cols is not None else temporal_columns(df))[:max_columns]
    parsed = {c: F.col(f"`{c}`").cast("timestamp") for c in cols}
    if not cols:
        return df, []
    row = df.agg(*[F.count(parsed[c]).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    out, report = df, []
    for i, c in enumerate(cols):
        if row[f"n{i}"] < min_values:
            continue
        base = c.replace(" ", "_").replace("/", "_").lower()[:20]
        ts = parsed[c]
        wd = F.weekday(ts)
        names = [f"{base}_annee", f"{base}_mois", f"{base}_jour_semaine", f"{base}_is_weekend",
                 f"{base}_anciennete_jours"]
        out = out.withColumns({
            names[0]: F.year(ts), names[1]: F.month(ts), names[2]: wd,
            names[3]: F.coalesce((wd >= 5).cast("int"), F.lit(0)),
            names[4]: F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts)) / 86400)
            .cast("long"),
        })
        report.append({"source": c, "type": "temporal", "features_created": names})
    return out, report


# ---------------------------------------------------------------- G3


def interaction_features(df: DataFrame, cols: list[str], max_interactions: int | None = None) -> tuple[DataFrame, list[dict]]:
    """For pairs (i < j) of ``cols``: ratio_{a}_vs_{b} when more than half of b is
    non-zero (NULL counts as non-zero, 0 -> NULL divisor), diff_{a}_vs_{b}; all pairs, or until
    ``max_interactions`` features exist (checked before each pair)."""
    pairs = [(a, b) for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    if not pairs:
        return df, []
    row = df.agg(*[F.avg(F.coalesce(F.col(f"`{b}`") != 0, F.lit(True)).cast("double")).alias(f"z{k}")
                   for k, b in enumerate(cols)]).first()
    nz = {b: row[f"z{k}"] for k, b in enumerate(cols)}
    created, report, new = 0, [], {}
    for a, b in pairs:
        if max_interactions is not None and created >= max_interactions:
            break
        ba, bb = _alnum(a, 10), _alnum(b, 10)
        feats = []
        if nz[b] > 0.5:
            name = f"ratio_{ba}_vs_{bb}"
            new[name] = F.col(f"`{a}`").cast("double") / F.nullif(F.col(f"`{b}`").cast("double"), F.lit(0.0))
            feats.append(name)
        name = f"diff_{ba}_vs_{bb}"
        new[name] = F.col(f"`{a}`") - F.col(f"`{b}`")
        feats.append(name)
        report.append({"source": [a, b], "type": "interaction", "features_created": feats})
        created += len(feats)
    return df.withColumns(new), report


# ---------------------------------------------------------------- G4


def group_mean_features(df: DataFrame, numeric: list[str], categorical: list[str],
                        max_cats: int | None = None, max_nums: int | None = None, lo: int = 2, hi: int = 30
                        ) -> tuple[DataFrame, list[dict]]:
    """{num}_mean_by_{cat} and {num}_ecart_{cat} for categoricals with 2..30 values
    and numerics; a NULL group gets NULL."""
    cats = categorical[:max_cats]
    nums = numeric[:max_nums]
    few = few_values(df, cats, hi)
    out, report = df, []
    for c in cats:
        if few[c] is None or len(few[c]) < lo or not nums:
            continue
        bc = _alnum(c, 8)
        means = (df.filter(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("__g"))
                 .agg(*[F.avg(F.col(f"`{n}`")).alias(f"__m_{i}") for i, n in enumerate(nums)]))
        out = out.join(F.broadcast(means), out[f"`{c}`"] == means["__g"], "left")
        feats = {}
        for i, n in enumerate(nums):
            bn = _alnum(n, 8)
            feats[f"{bn}_mean_by_{bc}"] = F.col(f"__m_{i}")
            feats[f"{bn}_ecart_{bc}"] = F.col(f"`{n}`") - F.col(f"__m_{i}")
            report.append({"source": [c, n], "type": "aggregation",
                           "features_created": [f"{bn}_mean_by_{bc}", f"{bn}_ecart_{bc}"]})
        out = out.withColumns(feats).drop("__g", *[f"__m_{i}" for i in range(len(nums))])
    return out, report


# ---------------------------------------------------------------- G5 / G6 / G7


def encoding_plan(df: DataFrame, cols: list[str] | None = None, max_columns: int | None = None) -> DataFrame:
    """(column, n_distinct, action) with action one_hot (<= 8), label (9..50), skipped (> 50)."""
    cols = (list(cols) if cols is not None else categorical_columns(df))[:max_columns]
    dc = distinct_counts(df, cols)
    rows = [(c, i, dc[c], "skipped" if dc[c] > 50 else ("one_hot" if dc[c] <= 8 else "label"))
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column string, ordinal long, n_distinct long, action string")


def encode_categoricals(df: DataFrame, cols: list[str] | None = None, source: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """G5 + G6 following the G7 plan: one-hot with prefix col[:12] (ints, NULL -> all 0),
    label codes in {col[:15]}_encoded (NULL -> -1); source columns dropped.
    ``source``: the table that the plan and the values are read from, where the same columns have a shorter lineage."""
    source = source if source is not None else df
    plan = encoding_plan(source, cols)
    action = {r["column"]: r["action"] for r in plan.orderBy("ordinal").collect()}
    values = few_values(source, [c for c, a in action.items() if a != "skipped"], 50)
    out = df
    for c, vals in values.items():
        if action[c] == "one_hot":
            out = one_hot(out, c, vals, prefix=c[:12], as_int=True)
        else:
            out = label_codes(out, c, vals, out=f"{c[:15]}_encoded", null_code=-1).drop(c)
    return out, plan


# ---------------------------------------------------------------- G8 / G9


def scaling_plan(df: DataFrame, cols: list[str] | None = None, max_scan: int | None = None,
                 max_scaled: int | None = None) -> DataFrame:
    """G8 decisions: eligible when >= 20 values, not already within [0, 1], and not already
    standard-like (|mean| < .5 and |sd - 1| < .5); robust if > 10% IQR outliers, else
    standard if |skew| < 1, else minmax. (column, method, mean, sd_pop, min, max, median, q1, q3)"""
    cols = [c for c in (list(cols) if cols is not None else numeric_columns(df))[:max_scan]
            if not c.endswith("_scaled")]
    bs = basic_stats(df, cols)
    elig = [c for c in cols if bs[c]["n"] >= 20
            and not (bs[c]["min"] >= 0 and bs[c]["max"] <= 1)]
    cs = central_sums(df, elig, {c: bs[c]["mean"] for c in elig})
    q = quantiles(df, elig, [0.25, 0.5, 0.75], stats=bs)
    rows, aggs = [], []
    for i, c in enumerate(elig):
        n = bs[c]["n"]
        mom = moments_from_sums(n, cs[f"m2_{i}"], cs[f"m3_{i}"], cs[f"m4_{i}"])
        if abs(bs[c]["mean"]) < 0.5 and mom["sd"] is not None and abs(mom["sd"] - 1) < 0.5:
            continue
        rows.append((c, n, bs[c]["mean"], math.sqrt(cs[f"m2_{i}"] / n), mom["skew"], bs[c]["min"],
                     bs[c]["max"], q[c][0], q[c][1], q[c][2]))
    rows = rows[:max_scaled]
    for r in rows:
        c, q1, q3 = r[0], r[7], r[9]
        iqr = q3 - q1
        x = F.col(f"`{c}`")
        aggs.append(F.avg(F.when(x.isNotNull(), ((x < q1 - 1.5 * iqr) | (x > q3 + 1.5 * iqr)).cast("double")))
                    .alias(c) if iqr > 0 else F.lit(0.0).alias(c))
    share = df.agg(*aggs).first().asDict() if aggs else {}
    out = []
    for r in rows:
        c, n, mean, sdp, skew, mn, mx, q1, med, q3 = r
        sk = abs(skew) if (skew is not None and n > 20) else 0.0
        method = "robust" if share[c] > 0.1 else ("standard" if sk < 1 else "minmax")
        out.append((c, method, share[c], sk, mean, sdp, mn, mx, med, q1, q3))
    return df.sparkSession.createDataFrame(
        out, "column string, method string, outlier_share double, abs_skew double, mean double, "
             "sd_pop double, min double, max double, median double, q1 double, q3 double")


def apply_scaling(df: DataFrame, plan: DataFrame) -> DataFrame:
    """G8 transform: median-impute then the chosen scaler into {col}_scaled
    (standard uses the population sd, robust centres on the median, as scikit-learn does)."""
    new = {}
    for r in plan.collect():
        x = F.coalesce(F.col(f"`{r['column']}`").cast("double"), F.lit(r["median"]))
        if r["method"] == "standard":
            e = (x - F.lit(r["mean"])) / F.lit(r["sd_pop"]) if r["sd_pop"] else x - F.lit(r["mean"])
        elif r["method"] == "minmax":
            rng = r["max"] - r["min"]
            e = (x - F.lit(r["min"])) / F.lit(rng) if rng else x * 0.0
        else:
            iqr = r["q3"] - r["q1"]
            e = (x - F.lit(r["median"])) / F.lit(iqr) if iqr else x - F.lit(r["median"])
        new[f"{r['column']}_scaled"] = e
    return df.withColumns(new) if new else df


def log_transforms(df: DataFrame, cols: list[str] | None = None, min_values: int = 30,
                   min_skew: float = 2.0, max_transforms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """log1p into {col[:15]}_log when >= 30 values, skew > 2 and min > 0; reports skew
    before and after. (column, original_skew, new_skew)"""
    cols = list(cols) if cols is not None else numeric_columns(df)
    bs = basic_stats(df, cols)
    cs = central_sums(df, cols, {c: bs[c]["mean"] for c in cols})
    chosen = []
    for i, c in enumerate(cols):
        n = bs[c]["n"]
        if n < min_values:
            continue
        sk = moments_from_sums(n, cs[f"m2_{i}"], cs[f"m3_{i}"], cs[f"m4_{i}"])["skew"]
        if sk is not None and sk > min_skew and bs[c]["min"] > 0:
            chosen.append((c, sk))
        if max_transforms is not None and len(chosen) >= max_transforms:
            break
    new = {f"{c[:15]}_log": F.log1p(F.col(f"`{c}`").cast("double")) for c, _ in chosen}
    out = df.withColumns(new) if new else df
    names = list(new)
    after = {}
    if names:
        bs2 = basic_stats(out, names)
        cs2 = central_sums(out, names, {c: bs2[c]["mean"] for c in names})
        for i, c in enumerate(names):
            after[c] = moments_from_sums(bs2[c]["n"], cs2[f"m2_{i}"], cs2[f"m3_{i}"], cs2[f"m4_{i}"])["skew"]
    rep = df.sparkSession.createDataFrame(
        [(c, sk, after[f"{c[:15]}_log"]) for c, sk in chosen],
        "column string, original_skew double, new_skew double")
    return out, rep


# ---------------------------------------------------------------- G10 PCA


def pca_features(df: DataFrame, cols: list[str], variance_threshold: float = 0.80,
                 max_components: int = 20, min_rows: int = 10, key: str | None = None
                 ) -> tuple[DataFrame | None, DataFrame]:
    """Median impute -> standardise (with mean) -> PCA(k = min(20, cols));
    keep the smallest n with cumulative explained variance >= 0.80 (at least 5); if that
    keeps < 0.6 of the variance use 0.9. Returns (components df, variance table)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    spark = df.sparkSession
    data = df.select(*([key] if key else []), *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    n = data.count()
    if n < min_rows or len(cols) < 2:
        return None, spark.createDataFrame([], "component int, explained double, cumulative double")
    k = min(max_components, len(cols), n)
    imp = Imputer(strategy="median", inputCols=cols, outputCols=[f"{c}__i" for c in cols])
    va = VectorAssembler(inputCols=[f"{c}__i" for c in cols], outputCol="__v")
    sc = StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=True)
    pca = PCA(k=k, inputCol="__s", outputCol="__p")
    model = Pipeline(stages=[imp, va, sc, pca]).fit(data)
    ev = list(model.stages[-1].explainedVariance.toArray())
    cum, acc = [], 0.0
    for v in ev:
        acc += v
        cum.append(acc)
    keep = next((i + 1 for i, c in enumerate(cum) if c >= variance_threshold), len(cum))
    keep = max(keep, min(5, len(cum)))
    if cum[keep - 1] < 0.6:
        keep = next((i + 1 for i, c in enumerate(cum) if c >= 0.9), len(cum))
    table = spark.createDataFrame([(i + 1, float(ev[i]), float(cum[i])) for i in range(len(ev))],
                                  "component int, explained double, cumulative double") \
        .withColumn("kept", F.col("component") <= keep)
    comps = model.transform(data).select(*([key] if key else []), vector_to_array("__p").alias("__a"))
    comps = comps.select(*([key] if key else []), *[F.col("__a")[i].alias(f"PC{i + 1}") for i in range(keep)])
    return comps, table


# ---------------------------------------------------------------- G11 / G12 / G13


def selection_report(df: DataFrame, cols: list[str] | None = None, max_features: int | None = None,
                     var_threshold: float = 0.01, corr_threshold: float = 0.95) -> DataFrame:
    """Low-variance (population variance after median impute <= 0.01; only with
    >= 5 columns), redundant (|r| > 0.95 with any earlier column, the first of them up to a third of the
    columns, only when > 5 remain) and the cap. Reports; does not drop.
    (column, ordinal, var_pop, reason)"""
    cols = list(cols) if cols is not None else numeric_columns(df)
    spark = df.sparkSession
    reasons: dict[str, str] = {}
    med = quantiles(df, cols, [0.5])
    imputed = df.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(med[c][0])).alias(c) for c in cols])
    bs = basic_stats(imputed, cols)
    cs = central_sums(imputed, cols, {c: bs[c]["mean"] for c in cols})
    var_pop = {c: (cs[f"m2_{i}"] / bs[c]["n"]) if bs[c]["n"] else None for i, c in enumerate(cols)}
    if len(cols) >= 5:
        for c in cols:
            if var_pop[c] is not None and var_pop[c] <= var_threshold:
                reasons[c] = "low_variance"
    remaining = [c for c in cols if c not in reasons]
    if len(remaining) > 5:
        from quarry.operators.relate import pearson_pairs
        r = {(a, b): v for a, b, _, v in pearson_pairs(imputed.select(*remaining), remaining)}
        found = [b for j, b in enumerate(remaining) if any(
            abs(r.get((a, b)) or 0.0) > corr_threshold for a in remaining[:j])]
        for b in found[:len(remaining) // 3]:
            reasons[b] = "redundant"
    kept = [c for c in cols if c not in reasons]
    for c in kept[max_features:] if max_features is not None else []:
        reasons[c] = "over_cap"
    rows = [(c, i, var_pop[c], reasons.get(c, "kept")) for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "column string, ordinal long, var_pop double, reason string")


# ---------------------------------------------------------------- G14


def parse_date_strings(df: DataFrame) -> DataFrame:
    """String columns that U8 takes for dates become timestamps; values that do not parse become null."""
    from quarry.operators.profile import date_columns, parsed_date
    strings = [r["column"] for r in date_columns(df).collect() if r["is_date"] and r["kind"] == "categorical"]
    return df.withColumns({c: parsed_date(F.col(f"`{c}`")) for c in strings}) \
        if strings else df


def forge_features(df: DataFrame, as_of: str = "2025-01-01", target: str | None = None,
                   apply_pca: bool = False, max_features: int | None = None) -> tuple[DataFrame, dict]:
    """Date strings and dates -> interactions -> aggregations -> encoding -> log -> scaling -> PCA ->
    selection. Interactions and aggregations use the initial numeric list; log, scaling and PCA the
    numerics there are when they run."""
    report = {}
    df = parse_date_strings(df)
    nums0 = [c for c in numeric_columns(df) if c != target]
    cats0 = [c for c in categorical_columns(df) if c != target]
    out, report["temporal"] = temporal_features(df, as_of=as_of)
    prof = column_profile(df.select(*nums0), with_quantiles=False) if nums0 else None
    best = ([r["column"] for r in interaction_candidates(prof).orderBy("rank").collect()]
            if prof is not None else [])
    out, report["interactions"] = interaction_features(out, best)
    out, report["aggregations"] = group_mean_features(out, nums0, cats0)
    out, report["encoding"] = encode_categoricals(out, cats0, source=df)
    # the later steps each aggregate over this frame: materialise it once
    out = encoded = out.persist()
    nums = [c for c in numeric_columns(out) if c != target]
    out, report["log"] = log_transforms(out, nums)
    plan = scaling_plan(out, nums)
    out = apply_scaling(out, plan)
    report["scaling"] = plan
    if apply_pca:
        now = [c for c in numeric_columns(out) if c != target]
        if len(now) > 20:
            report["pca"] = pca_features(out, now)[1]
    final_nums = [c for c in numeric_columns(out) if c != target]
    report["selection"] = selection_report(out, final_nums, max_features)
    encoded.unpersist()  # the returned frame is lazy and reads its input again
    return out, report
