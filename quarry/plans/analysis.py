"""Composed analyses: the complete (smart) analysis flow as a chain of operators.

profile -> target (P17) -> key variables (P21) -> univariate (U1/U3) -> correlations
(C1-C3) -> tests (T1-T4) -> optional k sweep (K13/K16) -> optional feature forge (G14) -> optional models
(M16) -> chart, insight, recommendation and digest tables (R2-R9), collated into one result (R1). Each
stage passes small result tables forward; the row-level work stays in Spark aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import forge as G
from quarry.operators import insight as I
from quarry.operators import model as M
from quarry.operators import profile as P
from quarry.operators import relate as R
from quarry.operators import select as S
from quarry.operators import segment as K


def chart_rows(df: DataFrame, nums: list[str], cats: list[str], dna: DataFrame | None) -> DataFrame:
    """The charts of an analysis in one long table (chart, series, label, value, share): histogram bins by their
    lower edge, pie slices, and the segments' heatmap and radar."""
    h = P.histogram(df, nums).select(F.lit("histogram").alias("chart"), F.col("column").alias("series"),
                                     F.round("lo", 6).cast("string").alias("label"), F.col("n").cast("double").alias("value"),
                                     F.col("pct").alias("share"))
    out = h
    if cats:
        out = out.unionByName(P.pie(df, cats).select(F.lit("pie").alias("chart"), F.col("column").alias("series"), F.col("name").alias("label"),
                                                     F.col("value").cast("double").alias("value"), F.col("pct").alias("share")))
    if dna is not None:
        out = out.unionByName(K.heatmap_radar(dna).select(
            F.col("view").alias("chart"), F.concat(F.lit("segment_"), F.col("cluster").cast("string")).alias("series"),
            F.col("feature").alias("label"), F.col("value").cast("double").alias("value"), F.lit(None).cast("double").alias("share")))
    return out


def forge_rows(spark, report: dict) -> DataFrame:
    """What the forge did: (step, source, features), one row per made group of features or per decision."""
    rows = []
    for step, what in report.items():
        if isinstance(what, DataFrame):
            for r in what.collect():  # a row per column
                d = r.asDict()
                name = str(d.get("column", d.get("component", "")))
                rows.append((step, name, [str(d[k]) for k in ("action", "reason", "method", "scaler") if d.get(k) is not None]))
        else:
            for r in what or []:
                if isinstance(r, dict):
                    source = r.get("source", "")
                    rows.append((step, " - ".join(source) if isinstance(source, list) else str(source), list(map(str, r.get("features_created", [])))))
                else:
                    rows.append((step, str(r), []))
    return spark.createDataFrame(rows, "step string, source string, features array<string>")


def complete_analysis(df: DataFrame, key: str | None = None, prompt: str = "", target: str | None = None,
                      cluster: bool = False, forge: bool = False, model: bool = False, tune: bool = True) -> dict[str, DataFrame]:
    """The tables of a whole analysis by name. ``forge`` adds the forged frame and what each step made;
    ``model`` (with a key and a target) adds the tables of the model pipeline as model_<table>, whose best model
    then counts in insights, recommendations, headline and digest; ``tune`` is its grid search."""
    # every stage is an aggregate pass over the input with column pruning; nothing is pinned in memory
    prof = P.column_profile(df, with_quantiles=False)
    tgt, method = S.detect_target(df, prompt, target, prof)
    sel = S.selected_variables(prof, target=tgt)
    nums, cats = sel["numeric_analysis"], sel["categorical_analysis"]
    out: dict[str, DataFrame] = {"profile": prof}
    out["univariate_numeric"] = P.numeric_summary(df, nums)
    out["univariate_categorical"] = P.categorical_summary(df, cats)
    out["data_quality"] = P.data_quality(df)
    corr_cols = sel["correlation_vars"]
    numeric_target = tgt in nums
    # one Gram matrix for C1, C3 and T3, centred by the profile's means
    means = {r["column"]: r["mean"] for r in prof.filter("kind = 'numeric'").select("column", "mean").collect()}
    pairs = R.PairSums(df, list(dict.fromkeys([*corr_cols, *nums, *([tgt] if numeric_target else [])])), means)
    out["pair_sums"] = pairs.table(df.sparkSession)
    out["correlations"] = R.correlation_pairs(df, corr_cols, pairs=pairs) if len(corr_cols) >= 2 else None
    out["target_correlations"] = (R.target_correlations(df, corr_cols, tgt, pairs=pairs)
                                  if numeric_target and len(corr_cols) >= 2 else None)
    out["tests"] = R.statistical_tests(df, tgt, nums, cats, numeric_target=numeric_target, pairs=pairs)
    seg_dna = None
    silhouette = None
    if cluster and key and len([c for c in nums if c != key]) >= 2:
        cvars = [r["column"] for r in S.clustering_variables(df, prof, nums).orderBy("rank").collect()] or nums
        cvars = [c for c in cvars if c != key]
        pts, runs = K.sweep(df.select(key, *cvars), cvars, key)
        out["clusterings"] = runs
        choice = runs.orderBy("choice_rank").first()
        if choice is not None:
            silhouette = choice["silhouette"]
            labels = pts.filter(F.col("k") == choice["k"]).select(key, F.col("cluster"))
            seg_dna, _ = K.cluster_dna(df.join(labels, key), cvars)
    quality = I.quality_insight(out["data_quality"])
    spark = df.sparkSession
    out["charts"] = chart_rows(df, nums, cats, seg_dna)
    if forge:
        out["forged"], report = G.forge_features(df.drop(key) if key else df, target=tgt)
        out["forge"] = forge_rows(spark, report)
    best = importance = None
    feats = [c for c in nums if c not in (tgt, key)]
    if model and key and tgt and feats:
        made = M.run_ml_pipeline(df, tgt, feats, key, tune)
        out |= {f"model_{name}": t for name, t in made.items()}
        best, importance = made.get("best"), made.get("importance")
    none = spark.createDataFrame([], "cluster int, feature string, ordinal long, size long, pct double, z double, direction string")
    dna = seg_dna if seg_dna is not None else none
    segmentation, segs = I.segmentation_insight(dna, silhouette), I.segment_insights(dna)
    corr_i = (I.correlation_insights(out["correlations"], out["target_correlations"])
              if out["correlations"] is not None else
              spark.createDataFrame([], "kind string, rank int, var1 string, var2 string, r double, "
                                        "shared_variance double"))
    tests_i = I.test_insights(out["tests"]) if "p_value" in out["tests"].columns else \
        spark.createDataFrame([], "ordinal int, variable1 string, variable2 string, test_type string, statistic double, "
                                  "p_value double, priority string")
    out["insights"] = I.insight_table(quality, segmentation, segs, corr_i, tests_i, best)
    out["recommendations"] = I.recommendations(segs, corr_i, tests_i, out["data_quality"], best)
    if "p_value" in out["tests"].columns and out["correlations"] is not None:
        out["headline"] = I.headline(out["data_quality"], tgt, out["correlations"], out["tests"], out.get("clusterings"), best, importance)
    out["summary"] = I.report_summary(out["insights"], out["recommendations"])
    out["digest"] = I.digest(out["univariate_numeric"], out["univariate_categorical"], out["tests"],
                             out["correlations"] if out["correlations"] is not None else
                             spark.createDataFrame([], "strength string"),
                             out["target_correlations"] if out["target_correlations"] is not None else
                             spark.createDataFrame([], "variable string"))
    out["digest"] = out["digest"].withColumn("best_silhouette", F.lit(silhouette).cast("double"))
    out["target"] = spark.createDataFrame([(tgt, method)], "target string, method string")
    return out
