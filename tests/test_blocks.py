"""k-means steps over blocks of rows, and a sweep that joins nothing."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quarry.operators import blocks, lloyd
from quarry.operators import segment as K


def _points(spark, n=6000):
    h = lambda i, m: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m)).cast("double")
    df = spark.range(n).select("id", (h(1, 50) + F.pmod("id", F.lit(3)) * 60).alias("a"), (h(2, 100_003) / 1000).alias("b"),
                               h(3, 5).alias("c"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(h(4, 30)).alias("d"))
    return df.unionByName(df.filter("id < 900").withColumn("id", F.col("id") + n)).repartition(3).persist()  # repeated points


@pytest.mark.parametrize("leaf", [4, 64])
def test_block_sums_are_sums_over_rows(leaf, monkeypatch):
    monkeypatch.setattr(blocks, "LEAF", leaf)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(2000, 3)), np.round(rng.normal(size=(1500, 3))), np.zeros((333, 3))])
    x = x[blocks._halved(x)]
    a, b = blocks._piece(x)
    leaves = np.frombuffer(b).reshape(-1, 9)
    centres = np.concatenate([rng.normal(size=(6, 4, 3)), np.round(rng.normal(size=(3, 4, 3))), np.zeros((1, 4, 3))])  # ties, equal centres
    looked = []

    def own(rows, c):
        looked.append(len(rows))
        return lloyd._sums(np.ascontiguousarray(rows.T), np.hstack([np.ones((len(rows), 1)), rows]), c)[1]
    got = blocks.sums(np.frombuffer(a).reshape(-1, 3), leaves[:, :3], leaves[:, 3:6], leaves[:, 6:], centres, own)
    for s, c in enumerate(centres):
        at = ((c ** 2).sum(axis=1)[:, None] - 2 * c @ x.T).argmin(axis=0)
        want = np.stack([np.append((at == j).sum(), x[at == j].sum(axis=0)) for j in range(4)])
        assert np.array_equal(got[s][:, 0], want[:, 0]) and np.allclose(got[s], want, atol=1e-8)
    if leaf == 4:
        assert sum(looked[:6]) < 0.9 * 6 * len(x)  # boxes inside one centre's region are not looked into


def test_steps_over_blocks_end_where_steps_over_rows_do(spark, monkeypatch):
    vec, _ = K.standardize(_points(spark), ["a", "b", "c", "d"], "id")
    begun = [c for _, _, c in lloyd.starts(vec, [2, 5], (1, 2), 3)]
    plain = lloyd.lloyd(vec, begun)
    seen = []
    made = blocks.blocks
    monkeypatch.setattr(blocks, "blocks", lambda *a: seen.append(1) or made(*a))
    monkeypatch.setattr(lloyd, "BLOCK_ROWS", 100)
    for name, v in (("LEAF", 8), ("PIECE", 500), ("REGION", 1000)):
        monkeypatch.setattr(blocks, name, v)
    found = lloyd.lloyd(vec, begun)
    assert seen
    for (c, cost), (c2, cost2) in zip(plain, found):
        assert np.allclose(c, c2, atol=1e-9) and abs(cost - cost2) < 1e-9 * cost


def test_blocks_hold_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PIECE", 256)
    df = _points(spark)
    x = df.select(F.array("a", "b", "c", "d").alias("x"))
    got = blocks.blocks(x, df.count(), 4).collect()
    rows = np.concatenate([np.frombuffer(r["x"]).reshape(-1, 4) for r in got])
    want = np.array([r["x"] for r in x.collect()])
    assert len(got) > 8 and np.array_equal(rows[np.lexsort(rows.T)], want[np.lexsort(want.T)])


def test_silhouettes_are_those_of_spark(spark):
    df = _points(spark)
    vec, _ = K.standardize(df, ["a", "b", "c", "d"], "id")
    zdf, _ = K.standardized(df, ["a", "b", "c", "d"], "id")
    found = {(2, 0): (np.array([[-1.0, 0, 0, 0], [1.0, 0, 0, 0]]), 0.0), (3, 0): (np.array([[-1.0, 0, 0, 0], [1.0, 0, 0, 0], [0, 1.7, 1.3, 1.4]]), 0.0)}
    for share in (0.0, 0.05):  # with and without small clusters merged
        for (k, s), (label, sizes, sil) in lloyd.silhouettes(zdf.select("z_a", "z_b", "z_c", "z_d"), found, share).items():
            pred = K.rebalance(vec.withColumn("prediction", lloyd.nearest(found[k, s][0])), "prediction", share)
            assert {r["prediction"]: r["count"] for r in pred.groupBy("prediction").count().collect()} == {i: n for i, n in enumerate(sizes) if n}
            assert abs(sil - K._silhouette(pred)) < 1e-9
    assert lloyd.merged_small(np.array([3, 90, 0, 7]), 0.05).tolist() == [1, 1, 2, 3]


def test_sweep_without_joins_is_the_sweep(spark, monkeypatch):
    df = _points(spark, 2000)
    cols = ["a", "b", "c", "d"]
    points, runs = K.sweep(df, cols, "id", ks=(2, 4), seeds=(42, 59), n_init=3)
    plain = {r["k"]: r for r in runs.collect()}
    at = {(r["k"], r["id"]): r for r in points.collect()}
    monkeypatch.setattr(lloyd, "BLOCK_ROWS", 100)
    monkeypatch.setattr(K, "labelled_axes", lambda *a: (_ for _ in ()).throw(AssertionError("joined")))
    points, runs = K.sweep(df, cols, "id", ks=(2, 4), seeds=(42, 59), n_init=3, unique=True)
    for r in runs.collect():
        assert r["method"] == plain[r["k"]]["method"] == "kmeans" and r["min_size"] == plain[r["k"]]["min_size"] and r["choice_rank"] == plain[r["k"]]["choice_rank"]
        assert all(abs(r[c] - plain[r["k"]][c]) < 1e-9 for c in ("silhouette", "balance", "dispersion", "quality_3d"))
    got = points.collect()
    assert len(got) == len(at)
    for r in got:
        old = at[r["k"], r["id"]]
        assert r["cluster"] == old["cluster"] and all(abs(r[a] - old[a]) < 1e-8 for a in "xyz")


def test_medians_only_of_columns_with_nulls(spark, monkeypatch):
    asked = []
    made = K.quantiles
    monkeypatch.setattr(K, "quantiles", lambda df, cols, q: asked.append(list(cols)) or made(df, cols, q))
    df = _points(spark, 300)
    K.standardized(df, ["a", "b"], "id")
    vec, _ = K.standardize(df.withColumn("b", F.when(F.col("id") > 20, F.col("b"))), ["a", "b"], "id")
    assert asked == [["b"]] and vec.count() == 600


def test_segments_bring_their_points_in_one_join(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "id long, v double")
    labels = spark.createDataFrame([(1, 0, 0.5, None), (3, 1, 0.0, 2.0)], "id long, cluster int, x double, y double")
    got = {r["id"]: tuple(r)[2:] for r in K.attach_segment(df, labels, "id", also=("x", "y")).collect()}
    assert got == {1: (0, 0.5, None), 2: (None, None, None), 3: (1, 0.0, 2.0)}
