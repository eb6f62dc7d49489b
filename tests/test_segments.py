"""K3-K5, K8: many starts, last resort and axes, against plain numpy."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quarry.operators import lloyd
from quarry.operators import segment as K


def vectors(spark, x):
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    names = [f"f{j}" for j in range(len(x[0]))]
    df = spark.createDataFrame(rows, ", ".join(["id long"] + [f"{c} double" for c in names])).repartition(4)
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


def plain(x, c):
    for _ in range(1000):
        at = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        new = np.stack([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
        if ((new - c) ** 2).sum() <= lloyd.TOLERANCE:
            break
        c = new
    return c, ((x[:, None] - c) ** 2).sum(axis=2).min(axis=1).sum()


def test_all_starts_come_to_what_each_would_alone(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) + rng.integers(0, 4, size=(300, 1)) * 3
    vec = vectors(spark, x)
    begun = lloyd.starts(vec, [2, 4], (1, 2), 5)
    assert len(begun) == 20
    ends = lloyd.lloyd(vec, [c for _, _, c in begun])
    for (_, _, c), (centres, inertia) in zip(begun, ends):
        want, cost = plain(x, c.copy())
        assert np.allclose(centres, want, atol=1e-6) and abs(inertia - cost) < 1e-6 * cost
    best = lloyd.best_of(vec, [4], (1, 2), 5)
    by_seed = {s: min(e[1] for (k, q, _), e in zip(begun, ends) if (k, q) == (4, s)) for s in (1, 2)}
    assert all(abs(best[4, s][1] - by_seed[s]) < 1e-9 for s in (1, 2))
    got = {r["id"]: r["p"] for r in vec.select("id", lloyd.nearest(best[4, 1][0]).alias("p")).collect()}
    assert [got[i] for i in range(300)] == ((x[:, None] - best[4, 1][0]) ** 2).sum(axis=2).argmin(axis=1).tolist()


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_last_resort_groups_points(spark, k):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(120, 2)) + (np.arange(120)[:, None] % k) * 6
    labelled, sil, method = K.last_resort(vectors(spark, x), "id", 2, k)
    assert method == "kmeans_3d" and labelled.count() == 120 and sil > 0
    assert labelled.select("prediction").distinct().count() >= 2


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_last_resort_splits_by_quartiles(spark, k):
    same, sil, method = K.last_resort(vectors(spark, [[1.0, 1.0]] * 40), "id", 2, k)
    assert (method, sil) == ("quartile", 0.0) and {r[0] for r in same.select("prediction").distinct().collect()} == {0}
    v = np.arange(41.0)
    got = [r["prediction"] for r in K.quartile_labels(spark.createDataFrame([(float(i),) for i in v], "v double"), "v", k).orderBy("v").collect()]
    q1, q2, q3 = np.percentile(v, [25, 50, 75])
    want = np.zeros(41, int)
    if k == 2:
        want[v > q2] = 1
    else:
        want[v > q3], want[v < q1] = 1, 2
        if k >= 4:
            want[(v >= q1) & (v <= q3) & (v > (q1 + q3) / 2)] = 3
    assert got == want.tolist()


def test_axes_vary_for_one_and_two_variables(spark):
    rng = np.random.default_rng(1)
    for dims in (1, 2, 4):
        axes = K.axes_3d(vectors(spark, rng.normal(size=(80, dims))), "id", dims)
        ext = axes.agg(*[F.min(a).alias(f"lo{a}") for a in "xyz"], *[F.max(a).alias(f"hi{a}") for a in "xyz"]).first()
        assert all(abs(ext[f"lo{a}"] + 10) < 1e-9 and abs(ext[f"hi{a}"] - 10) < 1e-9 for a in "xyz") and axes.count() == 80


def test_rows_of_few_partitions_are_dealt_to_the_cores(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "PART_ROWS", 100)
    df = spark.range(1000).coalesce(1)
    assert lloyd.dealt(df, 1000).rdd.getNumPartitions() == min(10, 2 * spark.sparkContext.defaultParallelism)
    assert lloyd.dealt(df.repartition(16), 300).rdd.getNumPartitions() == 3 and lloyd.dealt(df, 1000).count() == 1000


def test_clustering_model_equals_sparks_kmeans(spark):
    import random

    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.linalg import Vectors

    from quarry.operators import lloyd
    from quarry.operators import model as M
    rng = random.Random(3)
    vec = spark.createDataFrame([(i, Vectors.dense(rng.gauss(3 * (i % 4), 1.0), rng.gauss(i % 3, 0.7))) for i in range(900)], ["id", "features"]).repartition(3, "id").persist()
    calls = []
    made = lloyd.refined
    lloyd.refined = lambda *a: calls.append(len(a[1])) or made(*a)
    try:
        got = {r["k"]: r for r in M.clustering_model(vec).collect()}
    finally:
        lloyd.refined = made
    assert calls == [4]  # all k share their passes
    for k in (2, 3, 4, 5):
        m = KMeans(k=k, seed=42, featuresCol="features").fit(vec)
        assert abs(got[k]["inertia"] - m.summary.trainingCost) < 1e-6 * m.summary.trainingCost
        assert got[k]["sizes"] == m.summary.clusterSizes
        assert abs(got[k]["silhouette"] - ClusteringEvaluator(featuresCol="features").evaluate(m.transform(vec))) < 1e-9
