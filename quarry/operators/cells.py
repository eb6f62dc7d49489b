"""Rows that boosted trees cannot tell apart, as one weighted row each.

A tree of Spark sees of a number only which of at most BINS bins it falls in. All rows of the same bins of all features
go the same way in every tree, so the squared error sees of them only their number and the mean of their labels (a residual is
the label minus a function of the bins; what the labels scatter inside a cell is the same on both sides of any split). A boosted
model grown on the cells is the one grown on the rows, in rounds that cost cells, not rows: BINS ^ features of
them at most, and never more than rows.

The same holds for classes, with the class in the cell: impurity sees of a cell only its weight. A forest's tree draws each row
with a Poisson number of mean 1, so it draws a cell of n rows with one of mean n (the sum of n such numbers). Each tree is fitted by
Spark on the cells with its own draws, which depend on seed, cell and tree only."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spark's own maxBins.
BINS = 32
#: Cells are used for more rows than ROWS, and if there are at most rows / SHRINK of them.
ROWS, SHRINK = 100_000, 4
#: A number's forest grows on the draws of more rows than these cell by cell (grow.py), of fewer as Spark grows it.
FOREST_ROWS = 100_000
#: Cells of a partition, and trees of a forest that are fitted side by side.
PART_CELLS, AT_ONCE = 50_000, 8


def _few(bins: int):
    """mapInArrow body: (feature, its smallest values, at most bins + 1) of one task."""
    def run(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
            for j in range(x.shape[1]):
                if len(seen.get(j, ())) <= bins:
                    seen[j] = np.union1d(seen.get(j, np.zeros(0)), x[:, j])[:bins + 1]
        if seen:
            yield pa.RecordBatch.from_pydict({"j": pa.array(list(seen), pa.int32()), "v": pa.array([v.tolist() for v in seen.values()], pa.list_(pa.float64()))})
    return run


def edges(rows: DataFrame, bins: int = BINS) -> list[list[float]]:
    """Of each feature of the vectors ``features`` the edges between its bins: halfway between its values if they are at most
    ``bins``, as Spark's trees cut them, else quantiles over all rows."""
    x = rows.select(vector_to_array("features").alias("x"))
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list("v"))))
    told = {r["j"]: r["v"] for r in x.mapInArrow(_few(bins), "j int, v array<double>").groupBy("j")
            .agg(F.slice(merged, 1, bins + 1).alias("v")).collect()}
    many = sorted(j for j, v in told.items() if len(v) > bins)
    cuts = x.select(*[F.col("x")[j].alias(str(j)) for j in many]).approxQuantile([str(j) for j in many], [i / bins for i in range(1, bins)], 0.001) if many else []
    out = {j: [(a + b) / 2 for a, b in zip(v, v[1:])] for j, v in told.items()} | {j: sorted(set(q)) for j, q in zip(many, cuts)}
    return [out[j] for j in sorted(out)]


def with_bins(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """The rows with the vector __bins: of each feature the number of its bin."""
    names = [f"__bin{j}" for j in range(len(cuts))]
    x = rows.withColumns({f"{c}x": vector_to_array("features")[j] for j, c in enumerate(names)})
    splits = [[-float("inf"), *(cut or [0.0]), float("inf")] for cut in cuts]
    x = Bucketizer(splitsArray=splits, inputCols=[f"{c}x" for c in names], outputCols=names, handleInvalid="keep").transform(x)
    return x.withColumn("__bins", array_to_vector(F.array(*names))).drop(*names, *[f"{c}x" for c in names])


def cells(binned: DataFrame, by: list[str] = ()) -> DataFrame:
    """A row for each distinct __bins (and ``by``): __n its rows, __y their mean label and __v the squares of the labels' distances to it."""
    return (binned.groupBy(vector_to_array("__bins").alias("__b"), *by)
            .agg(F.count(F.lit(1)).cast("double").alias("__n"), F.avg("__y").alias("__mean"), (F.var_pop("__y") * F.count(F.lit(1))).alias("__v"))
            .select(array_to_vector("__b").alias("__bins"), *by, "__n", F.col("__mean").alias("__y"), "__v"))


def shrunk(rows: DataFrame, n: int, by: list[str] = (), train: DataFrame | None = None) -> tuple[list[list[float]], DataFrame, int] | None:
    """Edges (of the rows ``train`` where given), cached cells of the ``n`` rows and their number; None where they would not be much fewer."""
    if n <= ROWS:
        return None
    cuts = edges(rows if train is None else train)
    few = cells(with_bins(rows, cuts), by).persist()
    count = few.count()
    if count * SHRINK > n:
        few.unpersist()
        return None
    return cuts, few, count


def class_cells(rows: DataFrame, train: DataFrame, n: int, by: list[str]) -> tuple[list[list[float]], DataFrame] | None:
    """Edges from the ``n`` rows ``train`` and the cached cells of the cached ``rows``: __bins, ``by`` (with the class __y
    and its weight __w), __n. None where they would not be much fewer than the rows."""
    if n <= ROWS:
        return None
    cuts = edges(train)
    few = (with_bins(rows, cuts).groupBy(vector_to_array("__bins").alias("__b"), *by).agg(F.count(F.lit(1)).alias("__n"))
           .select(array_to_vector("__b").alias("__bins"), F.xxhash64("__b", "__y").alias("__cell"), *by, "__n").persist())
    count = few.count()
    if count * SHRINK > rows.count():
        few.unpersist()
        return None
    few_rows = few.coalesce(max(1, -(-count // PART_CELLS))).persist()
    few_rows.count()
    few.unpersist()
    return cuts, few_rows


def _draws(trees: int, seed: int):
    """Column function: of each (cell, rows) the number of its rows that each tree draws."""
    @F.pandas_udf("array<long>")
    def draws(cell: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([c % (1 << 64), seed]).poisson(m, trees) for c, m in zip(cell.tolist(), n.tolist())])
    return draws


def grown(est, few: DataFrame, seed: int):
    """The decision tree or forest of classes ``est`` fitted on cells as ``class_cells`` has them: in tasks that hold all cells (grow.py),
    beyond ``grow.MOST`` of them by Spark. Where nodes have a least number of rows, a cell counts as that many rows if it has them."""
    from concurrent.futures import ThreadPoolExecutor

    from quarry.operators import grow
    classes = int(few.agg(F.max("__y")).first()[0]) + 1
    y = F.col("__y").alias("__y", metadata={"ml_attr": {"type": "nominal", "name": "__y", "num_vals": classes}})  # the same in every tree
    if few.count() <= grow.MOST:
        got = few.groupBy(vector_to_array("__bins").alias("b"), "__w", "__y").agg(F.sum("__n").alias("n")).toPandas()
        return grow.class_trees(few.sparkSession, np.stack(got["b"].to_list()).astype(np.int64), got["__y"].to_numpy(), got["__w"].to_numpy(float),
                                got["n"].to_numpy(np.int64), est, seed, classes)
    per = few.groupBy("__bins", "__cell", "__w", "__y").agg(F.sum("__n").alias("__n")) if "__fold" in few.columns else few
    own = {est.featuresCol: "__bins", est.weightCol: "__weight"}
    parts = max(1, -(-few.count() // PART_CELLS))
    if not hasattr(est, "numTrees"):
        least = est.getMinInstancesPerNode()
        pieces = F.least(F.col("__n"), F.lit(least)).cast("int")
        rows = per.withColumn("__weight", F.col("__w") * F.col("__n") / pieces).withColumn("__piece", F.explode(F.sequence(F.lit(1), pieces)))
        return est.copy(own).fit(rows.select("__bins", "__weight", y).coalesce(parts))
    trees = est.getNumTrees()
    drawn = per.select("__bins", "__w", y, _draws(trees, seed)("__cell", "__n").alias("__drawn"))
    drawn = drawn.select("__bins", "__w", "__y", *[F.col("__drawn")[t].alias(f"__drawn{t}") for t in range(trees)])  # a fit reads its own
    drawn = drawn.coalesce(parts).persist()
    drawn.count()
    subset = "sqrt" if est.getFeatureSubsetStrategy() == "auto" and trees > 1 else est.getFeatureSubsetStrategy()

    def one(t: int):
        rows = drawn.withColumn("__weight", F.col("__w") * F.col(f"__drawn{t}")).filter(F.col("__weight") > 0).select("__bins", "__y", "__weight")
        lone = {est.numTrees: 1, est.bootstrap: False, est.featureSubsetStrategy: subset, est.seed: seed + 7919 * t}
        return est.copy(own | lone).fit(rows)

    with ThreadPoolExecutor(max_workers=AT_ONCE) as ex:
        single = list(ex.map(one, range(trees)))
    drawn.unpersist()
    return _joined(single, est.copy(own))


def _joined(single: list, est):
    """One forest of the trees of forests of one."""
    from pyspark import SparkContext
    from pyspark.ml.classification import RandomForestClassificationModel
    sc = SparkContext.getOrCreate()
    ml, first = sc._jvm.org.apache.spark.ml.classification, single[0]._java_obj
    trees = sc._gateway.new_array(ml.DecisionTreeClassificationModel, len(single))
    for i, model in enumerate(single):
        trees[i] = model._java_obj.trees()[0]
    whole = RandomForestClassificationModel(ml.RandomForestClassificationModel(first.uid() + "_joined", trees, first.numFeatures(), first.numClasses()))
    return whole.setFeaturesCol(est.getFeaturesCol())
