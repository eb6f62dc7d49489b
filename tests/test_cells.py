"""Boosted models grown on cells against those grown on the rows."""

import random

from pyspark.sql import functions as F

from quarry.operators import cells
from quarry.operators import model as M


def _frame(spark, n=3000):
    rng = random.Random(5)
    rows = [(i, float(rng.randrange(9)), float(rng.randrange(12)) if i % 50 else None, rng.random()) for i in range(n)]
    return spark.createDataFrame([(i, a, b, a * a - 3 * (b or 0.0) + r) for i, a, b, r in rows], "row_key long, a double, b double, y double").repartition(2, "row_key").persist()


def test_edges_are_midpoints_or_quantiles(spark):
    from pyspark.ml.feature import VectorAssembler
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"), F.lit(7.0).alias("c"))
    few, many, one = cells.edges(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df))
    assert few == [0.5, 1.5] and one == []
    assert len(many) == 31 and all(abs(e - 1000 * (i + 1) / 32) < 3 for i, e in enumerate(many))


def test_cells_hold_every_row_once(spark):
    from pyspark.ml.feature import VectorAssembler
    df = _frame(spark).fillna(0.0).withColumnRenamed("y", "__y")
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    got = cells.cells(cells.with_bins(rows, cells.edges(rows))).agg(F.count(F.lit(1)), F.sum("__n"), F.sum(F.col("__n") * F.col("__y"))).first()
    assert got[0] == 9 * 12 and got[1] == 3000 and abs(got[2] - df.agg(F.sum("__y")).first()[0]) < 1e-6


def test_boosting_on_cells_equals_boosting_on_rows(spark, monkeypatch):
    df = _frame(spark)
    rows = {r["model"]: r for r in M.train_regressors(df, ["a", "b"], "y", "row_key").collect()}
    monkeypatch.setattr(cells, "ROWS", 100)
    grown = []
    made = cells.cells
    monkeypatch.setattr(cells, "cells", lambda *a: grown.append(1) or made(*a))
    few = {r["model"]: r for r in M.train_regressors(df, ["a", "b"], "y", "row_key").collect()}
    assert grown  # the boosted model saw cells
    for name in rows:
        for c in ("train_rmse", "val_mae", "test_r2"):
            assert abs(rows[name][c] - few[name][c]) < 1e-6 * max(1.0, abs(rows[name][c])), (name, c)


def test_search_on_cells_scores_as_on_rows(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    df = _frame(spark).fillna(0.0).withColumnRenamed("y", "__y")
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).select("row_key", "features", "__y")
    models = {"gradient_boosting": GBTRegressor(featuresCol="features", labelCol="__y", seed=42)}
    grids = {"gradient_boosting": {"learning_rate": [0.1], "max_depth": [2, 3], "n_estimators": [3, 6]}}
    before = M.grid_search(rows, "row_key", models, grids, True)["gradient_boosting"]
    monkeypatch.setattr(cells, "ROWS", 100)
    after = M.grid_search(rows, "row_key", models, grids, True)["gradient_boosting"]
    assert before["best"] == after["best"]
    for (p, mean, sd), (q, mean2, sd2) in zip(before["points"], after["points"]):
        assert p == q and abs(mean - mean2) < 1e-6 * abs(mean) and abs(sd - sd2) < 1e-5 * abs(mean)


def test_train_sizes_are_those_of_the_split(spark):
    df = spark.range(400).select(F.col("id").alias("k"), F.when(F.col("id") < 1, "a").when(F.col("id") < 4, "b").when(F.col("id") < 29, "c").otherwise("d").alias("y"))
    want = {r["y"]: r["count"] for r in M.stratified_split(df, "k", "y").filter("split = 'train'").groupBy("y").count().collect()}
    assert {r["__wl"]: r["__wn"] for r in M._train_sizes(df, "y").collect()} == want


def test_medians_only_of_columns_with_gaps(spark):
    df = _frame(spark)
    assert M._lacking(df, ["a", "b"]) == ["b"]
    assert len(M._prep_stages(["a", "b"], ["b"])) == 3 and len(M._prep_stages(["a", "b"], [])) == 2
