"""Trees, forests and boosted models grown on cells in tasks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from quarry.operators import cells, grow
from quarry.operators import model as M


def _rows(spark, n=4000):
    h = lambda i, m: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m)).cast("double")
    df = spark.range(n).select("id", h(1, 9).alias("a"), h(2, 7).alias("b"), h(3, 100).alias("c"))
    y = F.col("a") * 3 + F.when(F.col("b") > 3, F.col("a")).otherwise(0.0) + F.col("c") / 10
    return df.withColumn("y", y).withColumn("label", F.concat(F.lit("k"), F.pmod((F.col("a") > 3).cast("int") + (F.col("b") > 3).cast("int") + (F.col("c") < 10).cast("int"), F.lit(3)).cast("string"))).repartition(3, "id").persist()


def _none(self, df):
    raise AssertionError(f"{type(self).__name__} was fitted by Spark")


def test_class_trees_grow_without_a_fit_of_spark(spark, monkeypatch):
    df = _rows(spark)
    monkeypatch.setattr(cells, "ROWS", 100)
    monkeypatch.setitem(M.GRIDS, "random_forest", {"max_depth": [2, 4], "n_estimators": [3, 6]})
    for est in (DecisionTreeClassifier, RandomForestClassifier):
        monkeypatch.setattr(est, "_fit", _none)
    metrics, importance = M.train_classifiers(df, ["a", "b"], "label", "id", n_classes=3, tune=True)
    got = {r["model"]: r for r in metrics.collect()}
    assert len(got["random_forest"]["grid"]) == 4 and len(got["decision_tree"]["grid"]) == 9
    assert got["decision_tree"]["val_accuracy"] > 0.4 and got["random_forest"]["val_accuracy"] > 0.4
    for name in ("decision_tree", "random_forest"):
        assert abs(sum(r["importance"] for r in importance.filter(F.col("model") == name).collect()) - 1) < 1e-9


def test_number_trees_grow_without_a_fit_of_spark(spark, monkeypatch):
    df = _rows(spark)
    plain = {r["model"]: r for r in M.train_regressors(df, ["a", "b"], "y", "id").collect()}
    monkeypatch.setattr(cells, "ROWS", 100)
    monkeypatch.setattr(cells, "FOREST_ROWS", 100)
    for est in (DecisionTreeRegressor, RandomForestRegressor, GBTRegressor):
        monkeypatch.setattr(est, "_fit", _none)
    got = {r["model"]: r for r in M.train_regressors(df, ["a", "b"], "y", "id").collect()}
    assert list(got) == list(plain)
    for name in plain:
        for c in ("train_rmse", "val_mae", "test_r2"):
            near = 0.05 if name == "random_forest" else 1e-6  # a forest draws
            assert abs(got[name][c] - plain[name][c]) < near * max(1.0, abs(plain[name][c])), (name, c)


def test_search_of_numbers_scores_as_on_rows(spark, monkeypatch):
    df = _rows(spark).withColumnRenamed("y", "__y")
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).select("id", "features", "__y")
    from pyspark.ml.regression import LinearRegression
    models = {"ridge": LinearRegression(labelCol="__y", elasticNetParam=0.0), "lasso": LinearRegression(labelCol="__y", elasticNetParam=1.0),
              "decision_tree": DecisionTreeRegressor(labelCol="__y", seed=42), "gradient_boosting": GBTRegressor(labelCol="__y", seed=42),
              "random_forest": RandomForestRegressor(labelCol="__y", seed=42)}
    grids = {"ridge": {"alpha": [0.1, 100.0]}, "lasso": {"alpha": [0.01, 1.0]}, "decision_tree": {"max_depth": [2, 4]},
             "gradient_boosting": {"learning_rate": [0.1], "max_depth": [2], "n_estimators": [2, 4]}, "random_forest": {"max_depth": [3, 5], "n_estimators": [10, 20]}}
    before = M.grid_search(rows, "id", models, grids, True)
    monkeypatch.setattr(cells, "ROWS", 100)
    monkeypatch.setattr(cells, "FOREST_ROWS", 100)
    for est in (DecisionTreeRegressor, RandomForestRegressor, GBTRegressor):
        monkeypatch.setattr(est, "_fit", _none)
    after = M.grid_search(rows, "id", models, grids, True)
    for name in models:
        near = 0.25 if name == "random_forest" else 1e-6
        assert [p for p, _, _ in before[name]["points"]] == [p for p, _, _ in after[name]["points"]]
        for (p, mean, _), (_, mean2, _) in zip(before[name]["points"], after[name]["points"]):
            assert abs(mean - mean2) < near * abs(mean), (name, p, mean, mean2)


def test_rows_are_drawn_as_poisson_numbers(spark):
    k = grow._poisson_table()
    assert abs(k.mean() - 1) < 1e-5 and abs(k.var() - 1) < 1e-4
    ids = np.arange(200_000, dtype=np.uint64)
    got = [k[grow._mixed(ids ^ salt) >> np.uint64(44)] for salt in grow._mixed(np.arange(1, 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]
    assert all(abs(g.mean() - 1) < 0.02 and abs(g.var() - 1) < 0.03 for g in got)
    assert abs(np.corrcoef(got[0], got[1])[0, 1]) < 0.02 and abs(np.corrcoef(got[0], got[2])[0, 1]) < 0.02


@pytest.mark.parametrize("parts", [[0], [1, 2], [0, 1, 2]])
def test_moments_give_the_error_on_rows(spark, parts):
    df = _rows(spark, 500)
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).select("features", F.col("y").alias("__y"), F.pmod("id", F.lit(3)).alias("part"))
    sums = grow.Moments(rows, "part")
    b, a = np.array([1.5, -0.2, 0.3]), 2.0
    data = rows.filter(F.col("part").isin(parts)).collect()
    want = np.mean([(r["__y"] - r["features"].toArray() @ b - a) ** 2 for r in data])
    assert abs(sums.error(parts, b, a) - want) < 1e-9 * want
    few = sums.rows(spark, parts).collect()
    assert abs(sum(r["__n"] for r in few) - len(data)) < 1e-6 and abs(sum(r["__n"] * r["__y"] for r in few) - sum(r["__y"] for r in data)) < 1e-6 * len(data)


def test_regressors_of_many_rows_cache_plain_numbers_only(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic
    df = _rows(spark, 1500)
    monkeypatch.setattr(M, "CROWD_ROWS", 0)
    monkeypatch.setattr(cells, "ROWS", 100)
    monkeypatch.setattr(cells, "FOREST_ROWS", 100)
    held = []
    persist = Classic.persist
    monkeypatch.setattr(Classic, "persist", lambda self, *a, **k: held.append(self.columns) or persist(self, *a, **k))
    assert M.train_regressors(df, ["a", "b"], "y", "id").count() == 6
    assert held[0] == ["a", "b", "__y", "split"] and not any("features" in c for c in held)
