"""Trees, forests and boosted models grown on cells (cells.py) inside tasks.

The cells of a table are few by rule (MOST at most), so a task holds them all and grows whole trees: one histogram of (node, feature, bin)
a level, the splits of Spark's trees (gini or variance, the first of equal gains, a gain above 0). Trees of a forest, folds and points of
a grid are tasks side by side; no step of growing is a Spark job. Rows are read only for what needs them: a number's forest draws every row
for every tree in one pass (``drawn_forests``), linear models see sums of products (``Moments``), and errors are one pass for all models
(``scored``)."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.staged import _values

#: Cells (of all folds) that a task holds at most; drawn (cell, tree) numbers a task holds at a time; trees of a task.
MOST, DRAWN, CHUNK = 250_000, 8_000_000, 5
#: Rows that a task draws at a time.
BLOCK = 200_000


def _impurity(sums: np.ndarray, classes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Weight and impurity of nodes; ``sums``: class weights, or (weight, sum, sum of squares), in the last axis."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if classes:
            w = sums.sum(axis=-1)
            out = 1.0 - ((sums / w[..., None]) ** 2).sum(axis=-1)
        else:
            w = sums[..., 0]
            out = (sums[..., 2] - sums[..., 1] ** 2 / w) / w
    return w, np.where(w > 0, out, 0.0)


def grow(bins: np.ndarray, sums: np.ndarray, rows: np.ndarray, classes: bool, depth: int, least: int = 1,
         subset: int | None = None, rng: np.random.Generator | None = None) -> dict:
    """One tree as ``staged.node_tables`` has it, with ``gain``: per inner node its gain times its weight. ``bins``: cells x features;
    ``sums``: cells x statistics; ``rows``: how many rows each cell stands for. ``subset``: features that a node draws."""
    held = rows > 0
    bins, sums, rows = bins[held], sums[held], rows[held].astype(float)
    d, wide, kinds = bins.shape[1], int(bins.max(initial=0)) + 1, sums.shape[1]
    present = [np.unique(bins[:, j]) for j in range(d)]
    at, nodes = np.zeros(len(bins), np.int64), 1
    feature, cut, left, right, value, gains = ([] for _ in range(6))
    ids = np.array([0])
    made = 1
    for level in range(depth + 1):
        total = np.stack([np.bincount(at, sums[:, s], nodes) for s in range(kinds)], axis=1)
        w, own = _impurity(total, classes)
        value.append(total / np.maximum(w, 1e-300)[:, None] if classes else (total[:, 1] / np.maximum(w, 1e-300))[:, None])
        best, where = np.full(nodes, -np.inf), np.zeros(nodes, np.int64)
        if level < depth and wide > 1:
            gain = np.full((nodes, d, wide - 1), -np.inf)
            for j in range(d):
                key = at * wide + bins[:, j]
                hist = np.stack([np.bincount(key, sums[:, s], nodes * wide) for s in range(kinds)], axis=1).reshape(nodes, wide, kinds)
                n = np.bincount(key, rows, nodes * wide).reshape(nodes, wide)
                l_sum, l_n = hist.cumsum(axis=1)[:, :-1], n.cumsum(axis=1)[:, :-1]
                r_sum, r_n = total[:, None] - l_sum, n.sum(axis=1)[:, None] - l_n
                (lw, li), (rw, ri) = _impurity(l_sum, classes), _impurity(r_sum, classes)
                g = own[:, None] - (lw * li + rw * ri) / w[:, None]
                gain[:, j] = np.where((l_n >= least) & (r_n >= least) & (l_n > 0) & (r_n > 0), g, -np.inf)
            if subset is not None and subset < d:
                gain[rng.random((nodes, d)).argsort(axis=1).argsort(axis=1) >= subset] = -np.inf
            where = gain.reshape(nodes, -1).argmax(axis=1)
            best = gain.reshape(nodes, -1)[np.arange(nodes), where]
        split = best > 0
        f, b = where // max(wide - 1, 1), where % max(wide - 1, 1)
        edge = np.zeros(nodes)
        for i in np.flatnonzero(split):
            later = present[f[i]][present[f[i]] > b[i]]
            before = present[f[i]][present[f[i]] <= b[i]]
            edge[i] = (before[-1] + later[0]) / 2
        order = np.cumsum(split) - 1
        feature.append(np.where(split, f, -1))
        cut.append(edge)
        left.append(np.where(split, made + 2 * order, -1))
        right.append(np.where(split, made + 2 * order + 1, -1))
        gains.append(np.where(split, best * w, 0.0))
        nodes = 2 * int(split.sum())
        made += nodes
        if not nodes:
            break
        go = split[at]
        bins, sums, rows, at = bins[go], sums[go], rows[go], at[go]
        at = 2 * order[at] + (bins[np.arange(len(at)), f[at]] > b[at])
    return {"feature": np.concatenate(feature), "cut": np.concatenate(cut), "left": np.concatenate(left), "right": np.concatenate(right),
            "value": np.concatenate(value), "gain": np.concatenate(gains)}


def pruned(tree: dict) -> dict:
    """The tree whose leaves of one parent say different things, as Spark keeps it."""
    says = tree["value"].argmax(axis=1) if tree["value"].shape[1] > 1 else tree["value"][:, 0]
    feature = tree["feature"].copy()
    for i in range(len(feature) - 1, -1, -1):  # children stand behind their parents
        l, r = tree["left"][i], tree["right"][i]
        if feature[i] >= 0 and feature[l] < 0 and feature[r] < 0 and says[l] == says[r]:
            feature[i] = -1
    keep, todo = [], [0]
    while todo:
        i = todo.pop(0)
        keep.append(i)
        if feature[i] >= 0:
            todo += [tree["left"][i], tree["right"][i]]
    new = {int(old): k for k, old in enumerate(keep)}
    inner = feature[keep] >= 0
    child = lambda side: np.array([new[int(tree[side][i])] if feature[i] >= 0 else -1 for i in keep])
    return {"feature": feature[keep], "cut": np.where(inner, tree["cut"][keep], 0.0), "left": child("left"), "right": child("right"),
            "value": tree["value"][keep], "gain": np.where(inner, tree["gain"][keep], 0.0)}


class Grown:
    """A tree or forest of node tables over the vector __bins, with what is asked of Spark's models."""

    def __init__(self, tables: list[dict], n_features: int, classes: int = 0):
        self.tables, self.n_features = tables, n_features
        if classes:
            self.numClasses = classes

    def getFeaturesCol(self) -> str:
        return "__bins"

    @property
    def trees(self) -> list["Grown"]:
        return [Grown([t], self.n_features, getattr(self, "numClasses", 0)) for t in self.tables]

    @property
    def numNodes(self) -> int:
        return sum(len(t["feature"]) for t in self.tables)

    @property
    def toDebugString(self) -> str:
        return "Trees\n" + "\n".join(f"{f} {c:g} {l} {r} {v.tolist()}" for t in self.tables for f, c, l, r, v in zip(t["feature"], t["cut"], t["left"], t["right"], t["value"]))

    @property
    def featureImportances(self):
        from pyspark.ml.linalg import Vectors
        whole = np.zeros(self.n_features)
        for t in self.tables:
            inner = t["feature"] >= 0
            own = np.bincount(t["feature"][inner], t["gain"][inner], self.n_features)
            whole += own / own.sum() if len(self.tables) > 1 and own.sum() > 0 else own
        return Vectors.dense(whole / whole.sum() if whole.sum() > 0 else whole)

    def values(self, x: np.ndarray) -> np.ndarray:
        """Class, or number, of rows of bins."""
        (_, _, v), = _values(self.tables, x, [_depth(self.tables)], [len(self.tables)])
        return v.argmax(axis=1).astype(float) if hasattr(self, "numClasses") else v[:, 0]

    def transform(self, df: DataFrame) -> DataFrame:
        told = self.values

        @F.pandas_udf("double")
        def predict(bins: pd.Series) -> pd.Series:
            return pd.Series(told(np.stack(bins.to_list())) if len(bins) else np.zeros(0))
        return df.withColumn("prediction", predict(vector_to_array("__bins")))


def _depth(tables: list[dict]) -> int:
    deep = 0
    for t in tables:
        level = np.zeros(len(t["feature"]), np.int64)
        for i in np.flatnonzero(t["feature"] >= 0):
            level[[t["left"][i], t["right"][i]]] = level[i] + 1
        deep = max(deep, int(level.max(initial=0)))
    return deep


def in_tasks(spark, shared, jobs: list, run) -> list:
    """[run(shared, job)] of all jobs, a task each; ``shared`` is broadcast once."""
    if not jobs:
        return []
    sent = spark.sparkContext.broadcast(shared)
    out = spark.sparkContext.parallelize(jobs, len(jobs)).map(lambda job: pickle.dumps(run(sent.value, job))).collect()
    sent.unpersist()
    return [pickle.loads(x) for x in out]


def subset_of(est, d: int) -> int | None:
    """How many features a node of a forest draws, by the names of Spark's strategies; None for all."""
    classes, name = "Classif" in type(est).__name__, est.getFeatureSubsetStrategy()
    if name == "auto":
        name = "all" if est.getNumTrees() == 1 else "sqrt" if classes else "onethird"
    if name == "all":
        return None
    if name in ("sqrt", "onethird", "log2"):
        return max(1, int(np.ceil({"sqrt": d ** 0.5, "onethird": d / 3, "log2": np.log2(d) if d > 1 else 1}[name])))
    share = float(name)
    return max(1, int(np.ceil(share * d)) if share <= 1 and "." in name else min(int(share), d))


def class_trees(spark, bins: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray, est, seed: int, classes: int) -> Grown:
    """The tree or forest ``est`` on cells (bins, class, weight of a row, rows). A forest's tree draws a cell of n rows with a
    Poisson number of mean n, in the order of the cells."""
    order = np.lexsort([w, y, *bins.T[::-1]])
    shared = tuple(np.ascontiguousarray(a[order]) for a in (bins, y.astype(int), w, n))
    forest, d = hasattr(est, "numTrees"), bins.shape[1]
    trees = est.getNumTrees() if forest else 1
    depth, least = est.getMaxDepth(), est.getMinInstancesPerNode()
    subset = subset_of(est, d) if forest else None

    def run(held, job):
        b, kind, weight, rows = held
        out = []
        for t in job:
            rng = np.random.default_rng([seed, t])
            drawn = rng.poisson(rows) if forest else rows
            sums = np.zeros((len(b), classes))
            sums[np.arange(len(b)), kind] = weight * drawn
            out.append(pruned(grow(b, sums, drawn, True, depth, least, subset, rng)))
        return out

    jobs = [list(range(i, min(i + CHUNK, trees))) for i in range(0, trees, CHUNK)]
    return Grown([t for part in in_tasks(spark, shared, jobs, run) for t in part], d, classes)


def boosted(bins: np.ndarray, n: np.ndarray, mean: np.ndarray, rate: float, depth: int, counts: list[int], least: int = 1) -> dict[int, np.ndarray]:
    """{rounds: what the model of so many rounds says for each cell} as Spark boosts the squared error: the first tree on the label, the
    others on twice the residual."""
    told, out = np.zeros(len(n)), {}
    x = bins.astype(float)
    for i in range(max(counts)):
        label = mean if i == 0 else 2.0 * (mean - told)
        tree = grow(bins, np.stack([n, n * label, n * label * label], axis=1), n, False, depth, least)
        told = told + (1.0 if i == 0 else rate) * next(_values([tree], x, [depth], [1]))[2][:, 0]
        if i + 1 in counts:
            out[i + 1] = told
    return out


# ---------------------------------------------------------------- numbers: cells of sums, draws, linear models, errors


class NumberCells:
    """The cells of a table with a number as label, whole in arrays: per cell ``bins``; per part (a fold or split) and cell its rows ``n``,
    the sum ``s`` of their labels, and ``v``, the squares of the labels' distances to their mean."""

    def __init__(self, cuts: list, few: DataFrame, by: str | None):
        got = few.select(vector_to_array("__bins").alias("b"), F.col(by).alias("part") if by else F.lit(0).alias("part"), "__n", "__y", "__v").toPandas()
        b = np.stack(got["b"].to_list()).astype(np.int64)
        self.cuts = cuts
        self.codes, first, cell = np.unique(coded(b, cuts), return_index=True, return_inverse=True)
        self.bins = b[first]
        self.parts = sorted(got["part"].unique().tolist())
        part = np.searchsorted(self.parts, got["part"].to_numpy())
        shape = (len(self.parts), len(self.codes))
        self.n, self.s, self.v = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        n, y, v = (got[c].to_numpy(float) for c in ("__n", "__y", "__v"))
        np.add.at(self.n, (part, cell), n)
        np.add.at(self.s, (part, cell), n * y)
        np.add.at(self.v, (part, cell), v)

    def of(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        """Rows and mean label of the cells in the parts (0 where there are none)."""
        own = [self.parts.index(p) for p in parts]
        n = self.n[own].sum(axis=0)
        return n, self.s[own].sum(axis=0) / np.maximum(n, 1.0)

    def error(self, part, told: np.ndarray) -> float:
        """Mean squared error on the rows of a part of a model that says ``told`` for the cells."""
        i = self.parts.index(part)
        n = self.n[i]
        return float((self.v[i] + n * (self.s[i] / np.maximum(n, 1.0) - told) ** 2).sum() / max(n.sum(), 1.0))


def number_tree(cells: NumberCells, parts: list, depth: int, least: int = 1) -> dict:
    """A decision tree of a number on the rows of the parts."""
    n, mean = cells.of(parts)
    middle = (n * mean).sum() / n.sum()
    y = mean - middle
    tree = grow(cells.bins, np.stack([n, n * y, n * y * y], axis=1), n, False, depth, least)
    return tree | {"value": tree["value"] + middle}


def coded(bins: np.ndarray, cuts: list) -> np.ndarray:
    """One number for the bins of all features."""
    out = np.zeros(len(bins), np.int64)
    for j, c in enumerate(cuts):
        out = out * (len(c) + 1) + bins[:, j]
    return out


def countable(cuts: list) -> bool:
    """Whether all combinations of bins have numbers of 63 bits."""
    return float(np.prod([len(c) + 1.0 for c in cuts])) < 2 ** 62


def binned(x: np.ndarray, cuts: list) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)


def _poisson_table() -> np.ndarray:
    """Numbers drawn with the chances of a Poisson number of mean 1, for 2^20 equal chances."""
    k = np.arange(12)
    share = np.cumsum(np.exp(-1.0) / np.cumprod(np.maximum(k, 1)))
    return np.searchsorted(share, (np.arange(1 << 20) + 0.5) / (1 << 20)).astype(np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Equal chances from numbers (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn_forests(rows: DataFrame, cells: NumberCells, est, seed: int, without: list[int | None], by: str | None) -> dict:
    """{part left out (None: no part): forest ``est`` of a number}, all on the same draws. ``rows``: features, __y (, ``by``), cached by the
    caller. Each tree draws each row with a Poisson number of mean 1; a task sums rows and labels that the trees draw of each cell, so
    what moves is (cells x trees) numbers a task."""
    spark = rows.sparkSession
    trees, depth, d = est.getNumTrees(), est.getMaxDepth(), cells.bins.shape[1]
    subset, least = subset_of(est, d), est.getMinInstancesPerNode()
    names_ = cells.parts if by else [0]
    sent = spark.sparkContext.broadcast((cells.codes, cells.bins, cells.cuts, names_, _poisson_table()))
    size, parts = len(cells.codes), len(names_)
    step = max(CHUNK, DRAWN // max(1, size * parts) // CHUNK * CHUNK)
    x = rows.select(vector_to_array("features").alias("x"), F.col("__y").cast("double").alias("y"), (F.col(by) if by else F.lit(0)).cast("int").alias("part"))
    x = x.coalesce(spark.sparkContext.defaultParallelism).withColumn("id", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)))
    out: dict = {p: [] for p in without}
    for begin in range(0, trees, step):
        own = list(range(begin, min(begin + step, trees)))

        def draw(batches, own=own):
            codes, _, cuts, names, table = sent.value
            n, s = np.zeros((len(own), size * parts), np.float32), np.zeros((len(own), size * parts))
            salts = [_mixed(np.array([t + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0] for t in own]

            def add(held):
                at, y, ids = (np.concatenate(a) for a in zip(*held))
                for i, salt in enumerate(salts):
                    k = table[_mixed(ids ^ salt) >> np.uint64(44)]
                    some = np.flatnonzero(k)
                    k, where = k[some].astype(float), at[some]
                    n[i] += np.bincount(where, k, size * parts)
                    s[i] += np.bincount(where, k * y[some], size * parts)

            held, rows_held = [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
                cell = np.searchsorted(codes, coded(binned(v, cuts), cuts))
                part = np.searchsorted(names, np.asarray(batch.column("part")))
                held.append((part * size + cell, np.asarray(batch.column("y")), np.asarray(batch.column("id")).view(np.uint64)))
                rows_held += batch.num_rows
                if rows_held >= BLOCK:
                    add(held)
                    held, rows_held = [], 0
            if held:
                add(held)
            for c in range(0, len(own), CHUNK):
                yield pa.RecordBatch.from_pydict({"first": pa.array([own[c]], pa.int32()), "n": pa.array([n[c:c + CHUNK].tobytes()], pa.binary()),
                                                  "s": pa.array([s[c:c + CHUNK].tobytes()], pa.binary())})

        def grown(got: pd.DataFrame) -> pd.DataFrame:
            _, bins, _, names, _ = sent.value
            n = sum(np.frombuffer(b, np.float32).astype(float) for b in got["n"]).reshape(-1, parts, size)
            s = sum(np.frombuffer(b, float) for b in got["s"]).reshape(-1, parts, size)
            first, made = int(got["first"].iloc[0]), []
            for i in range(len(n)):
                for out_ in without:
                    keep = [k for k, p in enumerate(names) if out_ is None or p != out_]
                    w, total = n[i][keep].sum(axis=0), s[i][keep].sum(axis=0)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        square = np.where(w > 0, total ** 2 / w, 0.0)  # what labels scatter inside a cell is the same on both sides of a split
                    rng = np.random.default_rng([seed, first + i])
                    made.append((out_, first + i, grow(bins, np.stack([w, total, square], axis=1), w, False, depth, least, subset, rng)))
            return pd.DataFrame({"trees": [pickle.dumps(made)]})

        for r in x.mapInArrow(draw, "first int, n binary, s binary").groupBy("first").applyInPandas(grown, "trees binary").collect():
            for p, t, tree in pickle.loads(r["trees"]):
                out[p].append((t, tree))
    sent.unpersist()
    return {p: Grown([tree for _, tree in sorted(ts, key=lambda v: v[0])], d) for p, ts in out.items()}


class Moments:
    """Per part the rows, and the means and centred products of (features, label), from one pass."""

    def __init__(self, rows: DataFrame, by: str | None):
        def run(batches):
            held: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
                v = np.hstack([x, np.asarray(batch.column("y"))[:, None]])
                part = np.asarray(batch.column("part"))
                for p in np.unique(part):
                    held[int(p)] = _merged(held.get(int(p)), _moments(v[part == p]))
            if held:
                yield pa.RecordBatch.from_pydict({"part": pa.array(list(held), pa.int32()), "s": pa.array([pickle.dumps(m) for m in held.values()], pa.binary())})
        got = rows.select(vector_to_array("features").alias("x"), F.col("__y").cast("double").alias("y"),
                          (F.col(by) if by else F.lit(0)).cast("int").alias("part")).mapInArrow(run, "part int, s binary").collect()
        self.per: dict = {}
        for r in sorted(got, key=lambda r: (r["part"], bytes(r["s"]))):
            self.per[r["part"]] = _merged(self.per.get(r["part"]), pickle.loads(r["s"]))

    def of(self, parts) -> tuple[float, np.ndarray, np.ndarray]:
        out = None
        for p in parts:
            out = _merged(out, self.per[p])
        return out

    def rows(self, spark, parts) -> DataFrame:
        """(features, __y, __n): a few weighted rows of the same number, means and products, on which a linear model is the one on all rows."""
        from pyspark.ml.linalg import Vectors
        n, mean, prod = self.of(parts)
        values, vectors = np.linalg.eigh(prod / n)
        axes = vectors * np.sqrt(np.maximum(values, 0.0) * len(mean))
        points = np.vstack([mean + axes.T, mean - axes.T])
        flat = np.diag(prod) == 0
        points[:, flat] = mean[flat]
        return spark.createDataFrame([(Vectors.dense(p[:-1]), float(p[-1]), n / len(points)) for p in points], ["features", "__y", "__n"]).coalesce(1)

    def error(self, parts, coefficients: np.ndarray, intercept: float) -> float:
        """Mean squared error of a linear model on the rows of the parts."""
        n, mean, prod = self.of(parts)
        b = np.append(-np.asarray(coefficients, float), 1.0)
        return max(float(b @ prod @ b) / n, 0.0) + float(mean @ b - intercept) ** 2


def _moments(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    mean = v.mean(axis=0)
    return float(len(v)), mean, (v - mean).T @ (v - mean)


def _merged(a, b):
    if a is None:
        return b
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def scored(rows: DataFrame, lines: dict[str, tuple[np.ndarray, float]], cells: NumberCells | None, told: dict[str, np.ndarray],
           shift: float) -> dict[str, dict]:
    """{model: {split: {rmse, mae, r2}}} (``model.regression_metrics``) of linear models (coefficients, intercept) and of models with a value
    ``told`` for each cell, all from one pass over ``rows`` (features, __y, split). ``shift``: a number near the labels."""
    import math
    spark = rows.sparkSession
    names = [*lines, *told]
    sent = spark.sparkContext.broadcast((lines, (cells.codes, cells.cuts) if told else None, told))

    def run(batches):
        lines_, how, told_ = sent.value
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
            y, split = np.asarray(batch.column("y")), batch.column("split").to_numpy(zero_copy_only=False)
            guesses = [x @ b + a for b, a in lines_.values()]
            if how:
                cell = np.searchsorted(how[0], coded(binned(x, how[1]), how[1]))
                guesses += [v[cell] for v in told_.values()]
            e = np.stack(guesses) - y
            for sp in set(split.tolist()):
                own = split == sp
                z = y[own] - shift
                part = np.concatenate([[own.sum(), z.sum(), z @ z], (e[:, own] ** 2).sum(axis=1), np.abs(e[:, own]).sum(axis=1)])
                held[sp] = held[sp] + part if sp in held else part
        if held:
            yield pa.RecordBatch.from_pydict({"split": pa.array(list(held)), "s": pa.array(list(held.values()))})

    total: dict = {}
    for r in rows.select(vector_to_array("features").alias("x"), F.col("__y").alias("y"), "split").mapInArrow(run, "split string, s array<double>").collect():
        total[r["split"]] = total.get(r["split"], 0.0) + np.array(r["s"])
    sent.unpersist()
    out: dict = {}
    for i, name in enumerate(names):
        out[name] = {}
        for sp, v in total.items():
            n, sst = float(v[0]), float(v[2] - v[1] ** 2 / v[0])
            sse, sae = float(v[3 + i]), float(v[3 + len(names) + i])
            out[name][sp] = {"rmse": math.sqrt(sse / n), "mae": sae / n, "r2": (1 - sse / sst) if sst > 0 else float("nan")}
    return out
