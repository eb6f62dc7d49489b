"""Scores of trees cut at a depth and of the first trees of a forest, all from one fitted model.

A tree grown to depth 7 holds, in its inner nodes, the trees of depth 3 and 5: growing goes level by level and a node's
split looks at the node's rows only. The first 50 trees of a forest of 100 are a forest of 50. So one fit and one pass
over the held-out rows score every (depth, number of trees) of a grid."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir


def node_tables(model, spark) -> list[dict]:
    """Per tree its nodes as arrays: feature (-1 for a leaf), cut, left, right, and value (class shares, or one
    number). At most 2^(depth + 1) nodes a tree, whatever the rows."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    rows = rows.select("treeID", "nodeData.*") if "nodeData" in rows.columns else rows.select(F.lit(0).alias("treeID"), "*")
    trees: dict[int, list] = {}
    for r in rows.orderBy("treeID", "id").collect():
        trees.setdefault(r["treeID"], []).append(r)
    out = []
    for _, nodes in sorted(trees.items()):
        leaf = [n["leftChild"] < 0 for n in nodes]
        shares = [np.asarray(n["impurityStats"], float) for n in nodes] if hasattr(model, "numClasses") else None
        out.append({
            "feature": np.array([-1 if end else n["split"]["featureIndex"] for n, end in zip(nodes, leaf)]),
            "cut": np.array([0.0 if end else n["split"]["leftCategoriesOrThreshold"][0] for n, end in zip(nodes, leaf)]),
            "left": np.array([n["leftChild"] for n in nodes]), "right": np.array([n["rightChild"] for n in nodes]),
            "value": (np.stack([s / max(s.sum(), 1e-300) for s in shares]) if shares else np.array([[n["prediction"]] for n in nodes]))})
    sc = spark.sparkContext
    gone = sc._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(sc._jsc.hadoopConfiguration()).delete(gone, True)
    return out


def _values(trees: list[dict], x: np.ndarray, depths: list[int], counts: list[int]):
    """(depth, number of trees, mean value of each row) for all of both."""
    total = {d: 0.0 for d in depths}
    row = np.arange(len(x))
    for t, tree in enumerate(trees, 1):
        at = np.zeros(len(x), np.int64)
        for depth in range(max(depths) + 1):
            if depth in total:
                total[depth] = total[depth] + tree["value"][at]
            f = tree["feature"][at]
            down = np.where(x[row, np.maximum(f, 0)] <= tree["cut"][at], tree["left"][at], tree["right"][at])
            at = np.where(f >= 0, down, at)
        if t in counts:
            for d in depths:
                yield d, t, total[d] / t


def staged_scores(rows: DataFrame, model, depths: list[int], counts: list[int], label: str = "__y", features: str = "features",
                  count: str | None = None) -> list:
    """For held-out ``rows`` (features, label): (depth, trees, label, prediction, n, squared error) rows, by class
    counts for a classifier, one row a (depth, trees) for a regressor. ``count``: the column that holds how many
    rows a classifier's row stands for."""
    spark = rows.sparkSession
    trees = spark.sparkContext.broadcast(model.tables if hasattr(model, "tables") else node_tables(model, spark))
    classes = hasattr(model, "numClasses")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1), np.asarray(batch.column("y"))
            for d, t, value in _values(trees.value, x, depths, counts):
                if classes:
                    pair, at = np.unique(np.stack([y, value.argmax(axis=1).astype(float)], axis=1), axis=0, return_inverse=True)
                    n = np.zeros(len(pair), np.int64)
                    np.add.at(n, at.ravel(), np.asarray(batch.column("n")))
                    error = np.zeros(len(n))
                else:
                    pair, n, error = np.zeros((1, 2)), np.array([len(y)]), np.array([((value[:, 0] - y) ** 2).sum()])
                yield pa.RecordBatch.from_pydict({
                    "depth": pa.array(np.full(len(n), d, np.int32)), "trees": pa.array(np.full(len(n), t, np.int32)),
                    "y": pa.array(pair[:, 0]), "prediction": pa.array(pair[:, 1]), "n": pa.array(n), "error": pa.array(error)})

    shape = "depth int, trees int, y double, prediction double, n long, error double"
    n = F.col(count) if count else F.lit(1)
    return (rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), n.cast("long").alias("n")).mapInArrow(run, shape)
            .groupBy("depth", "trees", "y", "prediction").agg(F.sum("n").alias("n"), F.sum("error").alias("error")).collect())
