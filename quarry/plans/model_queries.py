"""Registered model queries (M1, M4-M19). Rule tables read a model-runs table computed from
the predictions fixture (per-model accuracy on each split), never inline values."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import model as M
from quarry.operators.profile import column_profile
from quarry.operators.segment import standardize
from quarry.plans import fixtures as FX
from quarry.plans.common import finish, oracle_finish, register
from quarry.sources.tables import load, with_row_key

P = lambda sql: FX.with_views(sql, "predictions")


@register("classification_errors", P(oracle_finish("""
SELECT model, count(*) AS n, CAST(sum(CASE WHEN label <> prediction THEN 1 ELSE 0 END) AS BIGINT) AS errors,
       avg(CASE WHEN label <> prediction THEN 1.0 ELSE 0.0 END) AS error_rate
FROM predictions GROUP BY model""", ["error_rate"])))
def q_classification_errors(spark, sf):
    return finish(M.classification_errors(FX.predictions(spark, sf), by=["model"]))


@register("confusion_matrix", P("""
SELECT model, label, prediction, count(*) AS n FROM predictions GROUP BY model, label, prediction"""))
def q_confusion_matrix(spark, sf):
    return M.confusion(FX.predictions(spark, sf), by=["model"])


@register("per_class_accuracy", P(oracle_finish("""
SELECT model, label, count(*) AS n, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy
FROM predictions GROUP BY model, label""", ["accuracy"])))
def q_per_class_accuracy(spark, sf):
    return finish(M.per_class_accuracy(FX.predictions(spark, sf), by=["model"]))


@register("residual_stats", P(oracle_finish("""
SELECT model, count(*) AS n, avg(y - y_hat) AS residual_mean, stddev_samp(y - y_hat) AS residual_sd,
       min(y - y_hat) AS residual_min, max(y - y_hat) AS residual_max
FROM predictions GROUP BY model""", ["residual_mean", "residual_sd", "residual_min", "residual_max"])))
def q_residual_stats(spark, sf):
    return finish(M.residual_stats(FX.predictions(spark, sf), by=["model"]))


RUNS_SQL = """
SELECT model, avg(CASE WHEN split = 'train' THEN ok END) AS train_score,
       avg(CASE WHEN split = 'val' THEN ok END) AS val_score,
       avg(CASE WHEN split = 'test' THEN ok END) AS test_score,
       count_if(split = 'train') AS n_train, CAST(10 AS BIGINT) AS n_features,
       10 > count_if(split = 'train') OR coalesce(avg(CASE WHEN split = 'val' THEN ok END), 0) = 1.0 AS overfit
FROM (SELECT *, CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END AS ok FROM predictions) p GROUP BY model"""
#: The quantities that the rules look at, from their definitions.
RULE_SQL = f"""
SELECT *, n_features * 1.0 / greatest(n_train, 1) AS ratio,
       CASE WHEN coalesce(train_score, 0) = 0 OR coalesce(val_score, 0) = 0 THEN 0.0 ELSE abs(train_score - val_score) END AS gap,
       coalesce(test_score, 0) >= 0.99 AS leak_test,
       coalesce(train_score, 0) >= 0.99 AND coalesce(val_score, 0) >= 0.99 AS leak_fit, coalesce(test_score, 0) AS te
FROM ({RUNS_SQL}) r"""
RUN_DOUBLES = ["train_score", "val_score", "test_score"]


def _runs(spark, sf):
    return M.split_metrics(FX.predictions(spark, sf), n_features=10)


@register("model_runs", P(oracle_finish(RUNS_SQL, RUN_DOUBLES)))
def q_model_runs(spark, sf):
    return finish(_runs(spark, sf))


@register("best_model", P(oracle_finish(f"""
SELECT * EXCLUDE (rnk), val_score >= 1.0 AS leak_warning, val_score AS rank_score FROM (
  SELECT *, row_number() OVER (ORDER BY val_score DESC, model) AS rnk FROM ({RUNS_SQL}) r) t WHERE rnk = 1""",
    RUN_DOUBLES + ["rank_score"])))
def q_best_model(spark, sf):
    return finish(M.best_model(_runs(spark, sf)))


HEALTH_SQL = f"""
SELECT * EXCLUDE (leak_test, leak_fit, te),
       CASE WHEN health_score >= 70 THEN 'bon' WHEN health_score >= 50 THEN 'modéré' ELSE 'critique' END AS health_status
FROM (
  SELECT *, CAST(greatest(0, least(100, 100
      - CASE WHEN leak_test THEN 60 WHEN leak_fit THEN 35 ELSE 0 END
      - CASE WHEN ratio > 0.3 THEN 25 WHEN ratio > 0.2 THEN 15 WHEN ratio > 0.15 THEN 8 ELSE 0 END
      - CASE WHEN gap > 0.2 THEN 20 WHEN gap > 0.1 THEN 10 ELSE 0 END
      - CASE WHEN te < 0.5 THEN 25 WHEN te < 0.6 THEN 15 WHEN te < 0.7 THEN 8 ELSE 0 END
      - CASE WHEN overfit THEN 10 ELSE 0 END
      - CASE WHEN n_train < 100 THEN 15 WHEN n_train < 300 THEN 8 ELSE 0 END)) AS BIGINT) AS health_score
  FROM ({RULE_SQL}) a) b"""


@register("model_health", P(oracle_finish(HEALTH_SQL, RUN_DOUBLES + ["ratio", "gap"])))
def q_model_health(spark, sf):
    return finish(M.model_health(_runs(spark, sf)))


@register("model_checks", P(oracle_finish(f"""
WITH r AS ({RULE_SQL})
SELECT model, 'feature_ratio' AS "check", CASE WHEN ratio > 0.3 THEN 'error' WHEN ratio > 0.2 THEN 'warning' ELSE 'ok' END AS status,
       ratio AS value FROM r
UNION ALL SELECT model, 'perfect_test', 'error', te FROM r WHERE leak_test
UNION ALL SELECT model, 'perfect_fit', 'error', te FROM r WHERE leak_fit AND NOT leak_test
UNION ALL SELECT model, 'train_val_gap', CASE WHEN gap > 0.15 THEN 'error' WHEN gap > 0.08 THEN 'warning' ELSE 'ok' END, gap
          FROM r WHERE NOT leak_fit AND NOT leak_test
UNION ALL SELECT model, 'test_score', CASE WHEN te >= 0.7 THEN 'ok' WHEN te >= 0.5 THEN 'warning' ELSE 'error' END, te
          FROM r WHERE NOT leak_fit AND NOT leak_test
UNION ALL SELECT model, 'train_rows', CASE WHEN n_train >= 500 THEN 'ok' WHEN n_train >= 200 THEN 'warning' ELSE 'error' END, n_train
          FROM r""", ["value"])))
def q_model_checks(spark, sf):
    return finish(M.model_checks(_runs(spark, sf)))


@register("model_confidence", P(oracle_finish(f"""
SELECT * EXCLUDE (ratio, gap, leak_test, leak_fit, te),
       CASE WHEN leak_test OR leak_fit OR gap > 0.15 OR ratio > 0.3 THEN 'faible' WHEN ratio > 0.2 THEN 'modéré'
            WHEN te < 0.5 THEN 'faible' WHEN te < 0.7 THEN 'modéré' ELSE 'élevé' END AS confidence,
       CASE WHEN ratio > 0.3 THEN 'critique' WHEN ratio > 0.2 THEN 'élevé' WHEN ratio > 0.1 THEN 'modéré' ELSE 'bon' END AS ratio_status
FROM ({RULE_SQL}) r""", RUN_DOUBLES)))
def q_model_confidence(spark, sf):
    return finish(M.model_confidence(_runs(spark, sf)))


@register("model_actions", P(f"""
WITH r AS ({RULE_SQL}),
f AS (
  SELECT model, 'perfect_score' AS rule, 'haute' AS priority FROM r WHERE leak_test OR leak_fit
  UNION ALL SELECT model, 'reduce_features', CASE WHEN ratio > 0.3 THEN 'haute' ELSE 'moyenne' END FROM r WHERE ratio > 0.2
  UNION ALL SELECT model, 'regularize', CASE WHEN gap > 0.2 THEN 'haute' ELSE 'moyenne' END FROM r
            WHERE gap > 0.1 AND NOT leak_test AND NOT leak_fit
  UNION ALL SELECT model, 'improve_performance', 'moyenne' FROM r WHERE te < 0.6 AND NOT leak_test AND NOT leak_fit
  UNION ALL SELECT model, 'collect_data', 'moyenne' FROM r WHERE n_train < 300)
SELECT model, rule, priority FROM f
UNION ALL
SELECT model, 'monitor', 'basse' FROM r WHERE (SELECT count(*) FROM f WHERE f.model = r.model) < 2"""))
def q_model_actions(spark, sf):
    return M.model_actions(_runs(spark, sf))


LI_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _risks_sql():
    feats = LI_FEATS
    const = " UNION ALL ".join(
        f"SELECT 'constant_column' AS risk, 'warning' AS level, CAST(NULL AS DOUBLE) AS value, '{c}' AS \"column\" "
        f"FROM lineitem HAVING count(DISTINCT {c}) <= 1" for c in feats)
    return oracle_finish(f"""
SELECT 'ratio' AS risk, CASE WHEN {len(feats)} * 1.0 / count(*) > 1 THEN 'high'
                             WHEN {len(feats)} * 1.0 / count(*) > 0.2 THEN 'warning' ELSE 'ok' END AS level,
       {len(feats)} * 1.0 / count(*) AS value, CAST(NULL AS VARCHAR) AS "column" FROM lineitem
UNION ALL
SELECT 'class_imbalance', CASE WHEN min(n) * 1.0 / max(n) < 0.1 THEN 'warning' ELSE 'ok' END, min(n) * 1.0 / max(n), NULL
FROM (SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1) c
UNION ALL {const}""", ["value"])


@register("overfitting_risks", _risks_sql())
def q_overfitting_risks(spark, sf):
    li = load(spark, sf, "lineitem").select(*LI_FEATS, "l_returnflag")
    prof = column_profile(li, with_quantiles=False)
    tp = M.target_profile(li, "l_returnflag")
    rows = li.count()
    return finish(M.overfitting_risks(prof, "l_returnflag", LI_FEATS, rows, (tp["min_class"], tp["max_class"])))


@register("target_checks", """
SELECT 'l_returnflag' AS target, count(l_returnflag) AS n, count(DISTINCT l_returnflag) AS n_distinct,
       count(l_returnflag) >= 20 AND count(DISTINCT l_returnflag) >= 2
       AND (count(DISTINCT l_returnflag) > 10 OR (SELECT min(n) FROM (SELECT count(*) AS n FROM lineitem
            WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag) c) >= 5) AS valid,
       'classification' AS problem_type
FROM lineitem""")
def q_target_checks(spark, sf):
    """M4 + M5 for a string target."""
    li = load(spark, sf, "lineitem")
    tp = M.target_profile(li, "l_returnflag")
    ok, _ = M.target_validity(tp)
    return spark.createDataFrame([("l_returnflag", tp["n"], tp["distinct"], ok, M.problem_type(tp))],
                                 "target string, n long, n_distinct long, valid boolean, problem_type string")


def _keyed(spark, sf):
    return with_row_key(load(spark, sf, "lineitem").select(*LI_FEATS, "l_returnflag"))


@register("stratified_split", """
SELECT label, split, count(*) AS n, CAST(sum(key) AS BIGINT) AS key_sum FROM (
  SELECT o_orderstatus AS label, o_orderkey AS key,
         CASE WHEN (r - 0.5) / n < 0.6 THEN 'train' WHEN (r - 0.5) / n < 0.8 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT o_orderstatus, o_orderkey, count(*) OVER (PARTITION BY o_orderstatus) AS n,
               row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || '|42'), o_orderkey) AS r FROM orders) x) y
GROUP BY label, split""")
def q_stratified_split(spark, sf):
    """M3: rows and key sum of every class in every split."""
    o = M.stratified_split(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")
    return o.groupBy(F.col("o_orderstatus").alias("label"), "split").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


@register("train_classifiers")
def q_train_classifiers(spark, sf):
    """Four classifiers on lineitem, metrics per split (rows-only)."""
    mt, _ = M.train_classifiers(_keyed(spark, sf), LI_FEATS, "l_returnflag", "row_key", n_classes=3)
    return mt


@register("feature_importance")
def q_feature_importance(spark, sf):
    """Normalised importances, top 10 per model (rows-only)."""
    _, it = M.train_classifiers(_keyed(spark, sf), LI_FEATS, "l_returnflag", "row_key", n_classes=3)
    return it


@register("train_regressors")
def q_train_regressors(spark, sf):
    """M7: six regressors predicting l_extendedprice (rows-only)."""
    df = _keyed(spark, sf)
    return M.train_regressors(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "row_key")


@register("cross_validation")
def q_cross_validation(spark, sf):
    """The score of each of five stratified folds (rows-only)."""
    return M.cross_validate(_keyed(spark, sf), LI_FEATS, "l_returnflag", "row_key")


@register("cv_folds", """
SELECT label, fold, count(*) AS n, CAST(sum(key) AS BIGINT) AS key_sum FROM (
  SELECT o_orderstatus AS label, o_orderkey AS key,
         CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || '|43'), o_orderkey) - 1) % 5 AS INTEGER) AS fold
  FROM orders) x GROUP BY label, fold""")
def q_cv_folds(spark, sf):
    """Rows and key sum of every class in every stratified fold."""
    o = M.folds_of(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")
    return o.groupBy(F.col("o_orderstatus").alias("label"), "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


@register("fold_scores")
def q_fold_scores(spark, sf):
    """Five-fold scores of a classifier and of a regressor on lineitem (rows-only)."""
    df = _keyed(spark, sf)
    return (M.fold_scores(df, LI_FEATS, "l_returnflag", "row_key")
            .unionByName(M.fold_scores(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "row_key", regression=True)))


@register("clustering_model")
def q_clustering_model(spark, sf):
    """M8: k by silhouette with Davies-Bouldin / Calinski-Harabasz / inertia (rows-only)."""
    vec, _ = standardize(_keyed(spark, sf), LI_FEATS, "row_key")
    return M.clustering_model(vec)


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    """M12 for a decision tree on orders, fitted on train and permuted 10 times on validation rows (rows-only)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import StringIndexer
    o = M.hash_split(load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus"), "o_orderkey")
    feats = ["o_totalprice", "o_custkey"]
    pipe = Pipeline(stages=[StringIndexer(inputCol="o_orderstatus", outputCol="__y", stringOrderType="alphabetAsc")]
                    + M._prep_pipeline(feats)
                    + [DecisionTreeClassifier(featuresCol="features", labelCol="__y", maxDepth=5, seed=42)])
    model = pipe.fit(o.filter("split = 'train'"))
    return M.permutation_importance(model, o.filter("split = 'val'"), feats, "o_orderkey")


@register("ml_pipeline")
def q_ml_pipeline(spark, sf):
    """M16 end to end on orders (status from price and dates; rows-only): health table."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus",
                                         F.month("o_orderdate").alias("month"))
    res = M.run_ml_pipeline(o, "o_orderstatus", ["o_totalprice", "o_custkey", "month"], "o_orderkey")
    return res.get("health", res["target"])


@register("ml_pipeline_regression")
def q_ml_pipeline_regression(spark, sf):
    """M16 with a number as target: health table of the six regressors (rows-only)."""
    o = load(spark, sf, "lineitem").select(*LI_FEATS, "l_linenumber")
    res = M.run_ml_pipeline(with_row_key(o), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "row_key")
    return res.get("health", res["target"])


@register("feature_reduction")
def q_feature_reduction(spark, sf):
    """M2 on 105 features derived from lineitem: variance filter, then the 50 best by ANOVA F for a string
    label; returns the kept names (rows-only)."""
    li = load(spark, sf, "lineitem")
    feats = [f"f{i}" for i in range(105)]
    cols = [F.pmod(F.col("l_partkey") * (i + 1) + F.col("l_linenumber") * i, F.lit(11 + i)).cast("double").alias(f) for i, f in enumerate(feats)]
    kept = M.auto_reduce(li.select("l_returnflag", *cols), feats, "l_returnflag", rows=li.count())
    return spark.createDataFrame([(k,) for k in kept], "feature string")
