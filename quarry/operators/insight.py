"""Insight, recommendation and run-status tables.

Inputs are the result tables of the other operators (pairs, tests, cluster DNA, model
runs, quality) -- each small -- and the outputs are tables with (category, metric,
priority) columns; prose rendering is out of scope. Run status is an aggregate over stage
events (batch here, Structured Streaming in quarry.streaming.status).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def priority_rank(c):
    """haute < moyenne < basse."""
    return F.when(c == "haute", 0).when(c == "moyenne", 1).otherwise(2)


def quality_insight(quality: DataFrame) -> DataFrame:
    """R5 quality row from the data_quality table: action when > 10% missing, priority haute
    when > 20%. (id, category, subject, metric, priority, action_required)"""
    return quality.select(
        F.lit("data_quality").alias("id"), F.lit("quality").alias("category"), F.col("quality").alias("subject"),
        F.col("completeness").alias("metric"),
        F.when(F.col("missing_pct") > 20, "haute").otherwise("moyenne").alias("priority"),
        (F.col("missing_pct") > 10).alias("action_required"))


def segment_insights(dna: DataFrame, min_abs_z: float = 0.3, top: int | None = None) -> DataFrame:
    """R2: per segment its distinctive features (|z| > 0.3) ranked by |z|, all unless ``top`` is set.
    A segment's priority is moyenne; the segmentation as a whole is ``segmentation_insight``."""
    w = Window.partitionBy("cluster").orderBy(F.abs(F.col("z")).desc(), F.col("ordinal"))
    d = dna.filter(F.abs(F.col("z")) > min_abs_z).withColumn("r", F.row_number().over(w))
    if top is not None:
        d = d.filter(F.col("r") <= top)
    return d.select("cluster", "size", "pct", F.col("r").alias("feature_rank"), "feature", "z", "direction",
                    F.lit("moyenne").alias("priority"))


def segmentation_insight(dna: DataFrame, silhouette) -> DataFrame:
    """R2: one row for a segmentation of two or more groups: their number, the silhouette (a number or a
    one-row column), its level, and priority haute above 0.2."""
    s = silhouette if isinstance(silhouette, Column) else F.lit(None if silhouette is None else float(silhouette)).cast("double")
    return (dna.agg(F.countDistinct("cluster").alias("n_clusters")).filter("n_clusters >= 2")
            .select("n_clusters", s.alias("silhouette"))
            .withColumn("separation", F.when(F.col("silhouette") > 0.5, "well_separated").when(F.col("silhouette") > 0.25, "separated")
                        .when(F.col("silhouette") > 0, "overlapping").otherwise("indicative"))
            .withColumn("priority", F.when(F.col("silhouette") > 0.2, "haute").otherwise("moyenne")))


def correlation_insights(pairs: DataFrame, target_corr: DataFrame | None, max_pairs: int = 5,
                         max_drivers: int = 3, driver_min: float = 0.3) -> DataFrame:
    """The first 5 strong pairs and the top 3 target drivers (|r| > 0.3), with shared
    variance r^2. (kind, rank, var1, var2, r, shared_variance)"""
    strong = (pairs.filter(F.col("strength") == "strong").filter(F.col("strength_rank") <= max_pairs)
              .select(F.lit("strong_pair").alias("kind"), F.col("strength_rank").alias("rank"), "var1", "var2", "r",
                      F.col("r_squared").alias("shared_variance")))
    if target_corr is None:
        return strong
    drv = (target_corr.filter(F.abs(F.col("r")) > driver_min).filter(F.col("rank") <= max_drivers)
           .select(F.lit("target_driver").alias("kind"), "rank", F.col("variable").alias("var1"),
                   F.lit(None).cast("string").alias("var2"), "r", F.col("r_squared").alias("shared_variance")))
    return strong.unionByName(drv)


def test_insights(tests: DataFrame) -> DataFrame:
    """Significant t-tests and ANOVAs (p < 0.05), priority haute when p < 0.01."""
    return (tests.filter(F.col("test_type").isin("ttest", "anova") & (F.col("p_value") < 0.05))
            .select("ordinal", "variable1", "variable2", "test_type", "statistic", "p_value",
                    F.when(F.col("p_value") < 0.01, "haute").otherwise("moyenne").alias("priority")))


def insight_table(quality: DataFrame, segmentation: DataFrame, segments: DataFrame, correlations: DataFrame, tests: DataFrame,
                  best: DataFrame | None) -> DataFrame:
    """Quality, segmentation, segment, relation, test and model insights with
    (id, category, subject, metric, priority). Strong pairs above 0.7 and target drivers are haute; a
    model is haute, and without one the row model_not_applicable is basse. ``best``: (model, rank_score)."""
    q = quality.select("id", "category", "subject", F.col("metric").cast("double").alias("metric"), "priority")
    g = segmentation.select(F.lit("clustering_global").alias("id"), F.lit("segmentation").alias("category"),
                            F.col("separation").alias("subject"), F.col("silhouette").alias("metric"), "priority")
    s = (segments.groupBy("cluster", "priority").agg(F.count(F.lit(1)).alias("n"))
         .select(F.concat(F.lit("segment_"), F.col("cluster").cast("string")).alias("id"),
                 F.lit("segment").alias("category"), F.col("cluster").cast("string").alias("subject"),
                 F.col("n").cast("double").alias("metric"), "priority"))
    c = (correlations.filter((F.col("kind") == "target_driver") | (F.abs(F.col("r")) > 0.7))
         .select(F.concat(F.col("kind"), F.lit("_"), F.col("rank").cast("string")).alias("id"),
                 F.lit("relation").alias("category"), F.concat_ws(" - ", "var1", "var2").alias("subject"),
                 F.col("shared_variance").alias("metric"), F.lit("haute").alias("priority")))
    t = tests.select(F.concat(F.lit("test_"), F.col("ordinal").cast("string")).alias("id"), F.lit("test").alias("category"),
                     F.concat_ws(" / ", "variable1", "variable2").alias("subject"), F.col("p_value").alias("metric"),
                     "priority")
    out = q.unionByName(g).unionByName(s).unionByName(c).unionByName(t)
    if best is None:
        none = quality.limit(1).select(F.lit("model_not_applicable").alias("id"), F.lit("model").alias("category"),
                                       F.lit(None).cast("string").alias("subject"), F.lit(None).cast("double").alias("metric"),
                                       F.lit("basse").alias("priority"))
        return out.unionByName(none)
    return out.unionByName(best.select(F.lit("model").alias("id"), F.lit("model").alias("category"), F.col("model").alias("subject"),
                                       F.col("rank_score").alias("metric"), F.lit("haute").alias("priority")))


def recommendations(segments: DataFrame, correlations: DataFrame, tests: DataFrame, quality: DataFrame,
                    best: DataFrame | None) -> DataFrame:
    """Rule rows (rule, priority, impact, order), ordered by priority then impact. Segmentation 85 and the
    largest segment 75, both haute; the first two strong pairs above 0.7 with |r| in percent, haute above
    0.8; the first two tests of the list that are significant 60, moyenne; quality 70 above 10 % missing,
    haute above 30; the best model's score in percent, haute above 0.7. r counts to three places, so that
    a rounding error of an exact r does not reach the percent."""
    seg = segments.agg(F.countDistinct("cluster").alias("k")).filter(F.col("k") > 0)
    row = lambda df, rule, priority, impact: df.select(rule.alias("rule"), priority.alias("priority"), impact.cast("long").alias("impact"))
    level = lambda high: F.when(high, "haute").otherwise("moyenne")
    pairs = (correlations.filter((F.col("kind") == "strong_pair") & (F.col("rank") <= 2)).withColumn("r", F.round("r", 3))
             .filter(F.abs(F.col("r")) > 0.7))
    out = (row(seg, F.lit("use_segmentation"), F.lit("haute"), F.lit(85))
           .unionByName(row(seg, F.lit("target_largest_segment"), F.lit("haute"), F.lit(75)))
           .unionByName(row(pairs, F.concat(F.lit("exploit_relation_"), F.col("var1"), F.lit("_"), F.col("var2")),
                            level(F.abs(F.col("r")) > 0.8), F.floor(F.round(F.abs(F.col("r")) * 1000) / 10)))
           .unionByName(row(tests.withColumn("rn", F.row_number().over(Window.orderBy("ordinal"))).filter(F.col("rn") <= 2),
                            F.concat(F.lit("act_on_"), F.col("variable1")), F.lit("moyenne"), F.lit(60)))
           .unionByName(row(quality.filter(F.col("missing_pct") > 10), F.lit("improve_collection"),
                            level(F.col("missing_pct") > 30), F.lit(70))))
    if best is not None:
        out = out.unionByName(row(best, F.lit("deploy_model"), level(F.col("rank_score") > 0.7), F.floor(F.col("rank_score") * 100)))
    w = Window.orderBy(priority_rank(F.col("priority")), F.col("impact").desc(), F.col("rule"))
    return out.withColumn("order", F.row_number().over(w))


def report_summary(insights: DataFrame, recs: DataFrame) -> DataFrame:
    """Counts of insights, recommendations and recommendations of high priority."""
    a = insights.agg(F.count(F.lit(1)).alias("n_insights"))
    b = recs.agg(F.count(F.lit(1)).alias("n_recommendations"), F.count_if(F.col("priority") == "haute").alias("n_high_priority"))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")


def headline(quality: DataFrame, target: str | None, pairs: DataFrame, tests: DataFrame, runs: DataFrame | None = None,
             best: DataFrame | None = None, importance: DataFrame | None = None, top: int = 5) -> DataFrame:
    """The headline metrics of an analysis as (metric, value) rows of text: rows, columns, missing
    percent, target, best k and its silhouette (``runs``: k, silhouette, choice_rank), strong pairs, tests
    and significant tests, best model and score, and the ``top`` features by importance."""
    text = lambda c: c.cast("string").alias("value")
    one = lambda df, name, value: df.select(F.lit(name).alias("metric"), text(value))
    out = (one(quality, "rows", F.col("rows")).unionByName(one(quality, "columns", F.col("columns")))
           .unionByName(one(quality, "missing_pct", F.round("missing_pct", 2)))
           .unionByName(one(quality, "target", F.lit(target)))
           .unionByName(one(pairs.agg(F.count_if(F.col("strength") == "strong").alias("n")), "strong_pairs", F.col("n")))
           .unionByName(one(tests.agg(F.count(F.lit(1)).alias("n")), "tests", F.col("n")))
           .unionByName(one(tests.agg(F.count_if(F.col("p_value") < 0.05).alias("n")), "significant_tests", F.col("n"))))
    if runs is not None:
        chosen = runs.filter("choice_rank = 1")
        out = out.unionByName(one(chosen, "best_k", F.col("k"))).unionByName(one(chosen, "best_silhouette", F.round("silhouette", 4)))
    if best is not None:
        out = out.unionByName(one(best, "best_model", F.col("model"))).unionByName(one(best, "best_score", F.round("rank_score", 4)))
        if importance is not None:
            feats = importance.join(best.select("model"), "model").filter(F.col("rank") <= top)
            out = out.unionByName(feats.select(F.concat(F.lit("top_feature_"), F.col("rank").cast("string")).alias("metric"), text(F.col("feature"))))
    return out


def digest(num_summary: DataFrame, cat_summary: DataFrame, tests: DataFrame, pairs: DataFrame,
           target_corr: DataFrame) -> DataFrame:
    """One-row digest: numeric / categorical counts, high-variance (cv > 1) and high-skew
    (|skew| > 1) among the first 5 numerics, columns > 20% missing, tests total /
    significant / rate, strong / moderate / target pair counts."""
    first5 = num_summary.filter(F.col("ordinal") < 5)
    n = num_summary.agg(F.count(F.lit(1)).alias("n_numeric"),
                        F.count_if(F.col("missing_pct") > 20).alias("num_missing20"))
    v = first5.agg(F.count_if(F.col("cv") > 1).alias("high_variance"),
                   F.count_if(F.abs(F.col("skew")) > 1).alias("high_skew"))
    c = cat_summary.agg(F.count(F.lit(1)).alias("n_categorical"),
                        F.count_if(F.col("missing_pct") > 20).alias("cat_missing20"))
    t = tests.agg(F.count(F.lit(1)).alias("tests_total"), F.count_if(F.col("p_value") < 0.05).alias("tests_significant"))
    p = pairs.agg(F.count_if(F.col("strength") == "strong").alias("strong_pairs"),
                  F.count_if(F.col("strength") == "moderate").alias("moderate_pairs"))
    tc = target_corr.agg(F.count(F.lit(1)).alias("target_pairs"))
    one = None
    for part in (n, v, c, t, p, tc):
        part = part.withColumn("__k", F.lit(1))
        one = part if one is None else one.join(part, "__k")
    return one.drop("__k").withColumn("columns_missing20", F.col("num_missing20") + F.col("cat_missing20")) \
        .withColumn("test_rate", F.when(F.col("tests_total") > 0, F.col("tests_significant") / F.col("tests_total")))


# ---------------------------------------------------------------- W1 / W2

STAGE_WEIGHTS = {"file_structure": 30, "eda": 35, "full_analysis": 35}


def run_progress(events: DataFrame, key: str = "file_id") -> DataFrame:
    """Per file, each stage counts once (max, not sum) with weights 30 / 35 / 35."""
    done = {s: F.max(F.when((F.col("stage") == s) & (F.col("status") == "completed"), 1).otherwise(0)).alias(s)
            for s in STAGE_WEIGHTS}
    g = events.groupBy(key).agg(*done.values())
    prog = sum(F.col(s) * w for s, w in STAGE_WEIGHTS.items())
    return g.select(key, *[(F.col(s) == 1).alias(f"{s}_completed") for s in STAGE_WEIGHTS],
                    prog.cast("long").alias("progress"))


def run_summary(events: DataFrame, key: str = "file_id") -> DataFrame:
    """Phases completed / skipped (failed only), duration in seconds, continuity status."""
    comp = F.count_distinct(F.when(F.col("status") == "completed", F.col("stage")))
    g = events.groupBy(key).agg(
        comp.alias("phases_completed"),
        (F.lit(len(STAGE_WEIGHTS)) - comp).alias("phases_skipped"),
        (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("duration_s"))
    return g.withColumn("status", F.when(F.col("phases_completed") == len(STAGE_WEIGHTS), "complete")
                        .otherwise("partial"))
