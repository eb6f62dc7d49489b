"""The one-aggregate metrics equal Spark ML's evaluators on every split."""

import itertools

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from conftest import SF_TINY
from quarry.operators import model as M
from quarry.sources.tables import load, with_row_key

FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def test_classification_metrics_match_evaluator(spark):
    li = M.hash_split(with_row_key(load(spark, SF_TINY, "lineitem")), "row_key")
    pm = Pipeline(stages=[StringIndexer(inputCol="l_returnflag", outputCol="__y")] + M._prep_pipeline(FEATS)
                  + [DecisionTreeClassifier(labelCol="__y", maxDepth=5, seed=1)]).fit(li)
    p = pm.transform(li)
    mm = M.classification_metrics(p)
    for sp in ("train", "val", "test"):
        q = p.filter(F.col("split") == sp)
        for k, m in (("accuracy", "accuracy"), ("precision", "weightedPrecision"),
                     ("recall", "weightedRecall"), ("f1", "f1")):
            assert abs(MulticlassClassificationEvaluator(labelCol="__y", metricName=m).evaluate(q) - mm[sp][k]) < 1e-12


def test_regression_metrics_match_evaluator(spark):
    li = M.hash_split(with_row_key(load(spark, SF_TINY, "lineitem")), "row_key").withColumn("__y", F.col("l_extendedprice"))
    pm = Pipeline(stages=M._prep_pipeline(["l_quantity", "l_discount"]) + [LinearRegression(labelCol="__y")]).fit(li)
    p = pm.transform(li)
    mm = M.regression_metrics(p)
    for sp in ("train", "val", "test"):
        q = p.filter(F.col("split") == sp)
        for k in ("rmse", "mae", "r2"):
            ref = RegressionEvaluator(labelCol="__y", metricName=k).evaluate(q)
            assert abs(ref - mm[sp][k]) < 1e-9 * max(1.0, abs(ref))


def test_every_grid_has_the_reference_points():
    count = lambda g: {m: len(list(itertools.product(*v.values()))) for m, v in g.items()}
    assert count(M.GRIDS) == {"logistic_regression": 3, "decision_tree": 9, "random_forest": 6, "linear_svm": 2}
    assert count(M.REGRESSION_GRIDS) == {"ridge": 4, "lasso": 4, "decision_tree": 3, "random_forest": 6, "gradient_boosting": 8}


def test_tuned_regressors_are_trained_with_their_best_point(spark, monkeypatch):
    monkeypatch.setattr(M, "REGRESSION_GRIDS", {"lasso": {"alpha": [1e9, 0.1]}, "decision_tree": {"max_depth": [1, 4]},
                                                "gradient_boosting": {"learning_rate": [0.1], "max_depth": [2], "n_estimators": [1, 2]},
                                                "random_forest": {"max_depth": [2], "n_estimators": [2, 3]}})
    li = spark.createDataFrame([(i, float(i % 17), float(i % 5), 3.0 * (i % 17) ** 2 + i % 5) for i in range(150)],
                               "row_key long, a double, b double, y double").coalesce(1)
    t = M.train_regressors(li, ["a", "b"], "y", "row_key", tune=True)
    got = {r["model"]: r for r in t.collect()}
    assert got["lasso"]["best_params"] == "alpha=0.1" and got["lasso"]["train_r2"] > 0.8  # 0 with alpha=1e9
    assert got["decision_tree"]["best_params"] == "max_depth=4"
    assert got["gradient_boosting"]["best_params"].endswith("n_estimators=2")
    assert {m: len(r["grid"]) for m, r in got.items()} == {"linear_regression": 0, "ridge": 0, "lasso": 2, "decision_tree": 2,
                                                          "random_forest": 2, "gradient_boosting": 2}
    assert M.grid_table(t).filter("best").count() == 4


def test_reduction_by_anova_in_one_pass_takes_what_the_selector_takes(spark):
    """Features with nulls, without variance and of equal values; one row of sums a class instead of a row a value."""
    import numpy as np
    from pyspark.ml.feature import Imputer, StringIndexer, UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler
    from pyspark.sql import functions as F

    from quarry.operators import model as M
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 101))
    y = rng.integers(0, 3, 300)
    x[:, :20] += y[:, None] * np.linspace(0, 4, 20)
    x[:, 30], x[:, 31], x[:, 32] = 5.0, x[:, 0], y
    names = [f"f{i}" for i in range(101)]
    rows = [(f"c{c}", *[None if i in (2, 40) and j % 9 == 0 else float(v) for i, v in enumerate(r)]) for j, (c, r) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "label string, " + ", ".join(f"{c} double" for c in names))
    plain = StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc").fit(df).transform(df)
    plain = Imputer(strategy="median", inputCols=names, outputCols=names).fit(plain).transform(plain)
    plain = VectorAssembler(inputCols=names, outputCol="__f").transform(plain)
    varied = VarianceThresholdSelector(varianceThreshold=0.01, featuresCol="__f", outputCol="__v").fit(plain)
    sel = UnivariateFeatureSelector(featuresCol="__v", outputCol="__s", labelCol="__y", selectionMode="numTopFeatures")
    sel.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(50)
    want = [names[varied.selectedFeatures[i]] for i in sorted(sel.fit(varied.transform(plain)).selectedFeatures)]
    seen = []
    real = M._best_by_anova
    M._best_by_anova = lambda *a: seen.append(a[3]) or real(*a)
    try:
        assert M.auto_reduce(df, names, "label", 300) == want
    finally:
        M._best_by_anova = real
    assert seen == [50]
