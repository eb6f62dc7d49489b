"""Models on many rows: trees and forests of classes on cells, splits without a shuffle of all rows, one narrow cache."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quarry.operators import cells, margin
from quarry.operators import model as M


def _classed(spark, n=120_000):
    """Two features of few values and a class that mostly follows them."""
    df = spark.range(n).select("id", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(12))).cast("double").alias("a"),
                               (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(9))).cast("double").alias("b"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(10)).alias("noise"))
    y = F.when(F.col("noise") < 2, F.pmod("noise", F.lit(2))).when((F.col("a") > 6) & (F.col("b") < 5), 1).otherwise(F.when(F.col("b") > 6, 2).otherwise(0))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.withColumn("__y", y.cast("double")).withColumn("__w", F.lit(1.0)))


def test_trees_on_cells_are_the_trees_on_rows(spark):
    rows = _classed(spark).persist()
    cuts, few = cells.class_cells(rows, rows, rows.count(), ["__y", "__w"])
    assert few.count() <= 12 * 9 * 3 and few.agg(F.sum("__n")).first()[0] == 120_000
    for least in (1, 5):
        est = DecisionTreeClassifier(featuresCol="features", labelCol="__y", weightCol="__w", maxDepth=4, minInstancesPerNode=least, seed=42)
        plain, small = est.fit(rows), cells.grown(est, few, 42)
        assert plain.numNodes == small.numNodes
        both = small.transform(cells.with_bins(plain.transform(rows).select("id", "features", F.col("prediction").alias("plain")), cuts))
        assert both.filter("plain <> prediction").count() == 0
        assert np.allclose(plain.featureImportances.toArray(), small.featureImportances.toArray(), atol=1e-9)
    rows.unpersist()


def test_forest_on_cells_draws_rows_and_reruns_agree(spark):
    rows = _classed(spark).persist()
    _, few = cells.class_cells(rows, rows, rows.count(), ["__y", "__w"])
    drawn = np.array([r["d"] for r in few.select(cells._draws(6, 42)("__cell", "__n").alias("d")).collect()])
    n = np.array([r["__n"] for r in few.select("__n").collect()])
    assert (np.abs(drawn.sum(axis=0) - 120_000) < 6 * 120_000 ** 0.5).all()  # each tree draws as many rows as there are
    assert 0.8 < (((drawn - n[:, None]) ** 2).mean(axis=1) / n).mean() < 1.2  # as Poisson draws of rows scatter
    est = RandomForestClassifier(featuresCol="features", labelCol="__y", weightCol="__w", numTrees=6, maxDepth=4, seed=42)
    first, again = (cells.grown(est, part, 42) for part in (few, few.repartition(3)))
    assert len(first.trees) == 6 and first.numClasses == 3 and abs(first.featureImportances.toArray().sum() - 1) < 1e-9
    assert [t.toDebugString.split("\n", 1)[1] for t in first.trees] == [t.toDebugString.split("\n", 1)[1] for t in again.trees]
    hit = first.transform(few).filter(F.col("prediction") == F.col("__y")).agg(F.sum("__n")).first()[0] / 120_000
    plain = est.fit(rows).transform(rows).filter(F.col("prediction") == F.col("__y")).count() / 120_000
    assert abs(hit - plain) < 0.03
    rows.unpersist()


def test_few_rows_take_no_cells(spark):
    rows = _classed(spark, 1000)
    assert cells.class_cells(rows, rows, 1000, ["__y", "__w"]) is None


def test_split_ranks_only_the_cut_cells(spark, monkeypatch):
    monkeypatch.setattr(M, "SPLIT_ROWS", 0)
    df = spark.range(9000).select("id", F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 < 7, "x").otherwise("y").alias("label"))
    df = df.unionByName(df.filter("id < 5"))  # repeated keys
    got = M.stratified_split(df, "id", "label")
    at = (F.col("__rank") - 0.5) / F.col("__n")
    want = M.class_ranks(df, "id", "label", 42).withColumn("split", F.when(at < 0.6, "train").when(at < 0.8, "val").otherwise("test"))
    assert got.columns == ["id", "label", "split"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("id", "label", "split").collect()))
    seen = []
    old, M._rank = M._rank, lambda key: seen.append(key) or F.lit(None).cast("long")
    try:  # without ranks only the rows of cut cells lack theirs, and fall to the last split
        loose = M.stratified_split(df, "id", "label")
        assert seen and loose.exceptAll(got).count() < 6 * 20
    finally:
        M._rank = old


def test_margin_from_a_sample_ends_where_it_does_from_zero(spark, monkeypatch):
    rows = margin.prepared(_classed(spark, 30_000)).persist()
    monkeypatch.setattr(margin, "BEGIN", 1000)
    problems = [(float(k), 0.1, -2) for k in range(3)]
    passes = []
    sums = margin._sums
    monkeypatch.setattr(margin, "_sums", lambda *a: passes.append(1) or sums(*a))
    cold = margin.solve(rows, problems, 2)
    n_cold = len(passes)
    warm = margin.solve(rows, problems, 2, 30_000)
    rows.unpersist()
    assert np.allclose(cold, warm, atol=2e-3) and n_cold > 3


def test_cross_validation_caches_its_rows_once(spark, monkeypatch):
    df = _classed(spark, 2000).select("id", "a", "b", F.col("__y").cast("string").alias("label"), F.lit("unused").alias("other"))
    held = []
    from pyspark.sql.classic.dataframe import DataFrame as Classic
    persist = Classic.persist
    monkeypatch.setattr(Classic, "persist", lambda self, *a, **k: held.append(self.columns) or persist(self, *a, **k))
    scores = M.cross_validate(df, ["a", "b"], "label", "id")
    assert scores.count() == 5 and held == [["a", "b", "__y", "__w", "split"]]


def test_digest_sums_its_pairs_once(spark, monkeypatch):
    from quarry.operators import relate as R
    from quarry.plans.catalog import QUERIES
    made = []
    init = R.PairSums.__init__
    monkeypatch.setattr(R.PairSums, "__init__", lambda self, *a, **k: made.append(1) or init(self, *a, **k))
    assert QUERIES["digest"](spark, "/root/testdata/sf0.001").count() == 1 and len(made) == 1


def test_sweep_keeps_no_labels_of_earlier_ks(spark):
    from quarry.operators import segment as K
    df = spark.range(600).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5 + F.col("id") % 2 * 40).cast("double").alias("b"))
    before = {r for r in spark.sparkContext._jsc.getPersistentRDDs()}
    points, runs = K.sweep(df, ["a", "b"], "id", ks=(2, 3), seeds=(42,), n_init=2)
    kept = [r for r in spark.sparkContext._jsc.getPersistentRDDs() if r not in before]
    assert len(kept) <= 1  # the vectors
    assert points.groupBy("k").count().filter("count = 600").count() == runs.count() == 2


def test_tuned_training_on_cells(spark, monkeypatch):
    monkeypatch.setattr(cells, "ROWS", 500)
    monkeypatch.setattr(M, "SPLIT_ROWS", 0)
    monkeypatch.setitem(M.GRIDS, "random_forest", {"max_depth": [2, 3], "n_estimators": [2, 3]})
    made = []
    grown = cells.grown
    monkeypatch.setattr(cells, "grown", lambda *a: made.append(1) or grown(*a))
    df = _classed(spark, 6000).select("id", "a", "b", F.concat(F.lit("c"), F.col("__y").cast("string")).alias("label"))
    metrics, importance, pred = M.train_classifiers(df, ["a", "b"], "label", "id", n_classes=3, with_predictions=True, tune=True)
    got = {r["model"]: r for r in metrics.collect()}
    assert made and len(got["random_forest"]["grid"]) == 4 and all(0.5 < got[m]["val_accuracy"] <= 1 for m in ("decision_tree", "random_forest"))
    for m in ("decision_tree", "random_forest", "linear_svm"):  # the predictions are those that the metrics count
        right = pred[m].filter("split = 'val'").agg(F.avg((F.col("__y") == F.col("prediction")).cast("double"))).first()[0]
        assert abs(right - got[m]["val_accuracy"]) < 1e-9
