"""k-means from many starts in one pass per step.

The starts' centres of every problem travel to the tasks; a step is one pass that assigns the rows to the
centres of all starts at once and sums rows, coordinates and inertia per centre, so that the driver sees
(starts x centres x features) numbers whatever the rows. A start that moves no more stays where it is; the steps
end with the last one, or after ``max_iter``.

Starts are chosen by k-means++ on at most SEEDING rows (those of the least hash): a bounded sample decides only
where the search begins, every step and the inertia are over all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEEDING = 4096
#: More rows than these lie in blocks (blocks.py) while centres move.
BLOCK_ROWS = 200_000
#: A start has settled when its centres' squared moves add up to this (vectors are standardised).
TOLERANCE = 1e-4
#: Rows of a partition at least, so that a small table is not dealt to more tasks than it fills.
PART_ROWS = 20_000


def _plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of x, each chosen by its squared distance to the nearest of those before."""
    at = [int(rng.integers(len(x)))]
    near = ((x - x[at[0]]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = near.sum()
        at.append(int(rng.choice(len(x), p=near / total)) if total > 0 else int(rng.integers(len(x))))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(axis=1))
    return x[at].copy()


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """Partitions of PART_ROWS rows or more; rows that lie in fewer partitions than there are cores are dealt anew."""
    most = max(1, -(-rows // PART_ROWS))
    wanted = min(most, 2 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df.coalesce(most)


def starts(vec: DataFrame, ks: list[int], seeds: tuple[int, ...], n_init: int) -> list[tuple[int, int, np.ndarray]]:
    """(k, seed, centres) of every start."""
    rows = vec.select(vector_to_array("features").alias("x")).withColumn("h", F.xxhash64("x")).orderBy("h", "x").limit(SEEDING).collect()
    x = np.array([r["x"] for r in rows], float)
    out = []
    for k in ks:
        for seed in seeds:
            rng = np.random.default_rng([seed, k])
            out += [(k, seed, _plus_plus(x, k, rng)) for _ in range(n_init)]
    return out


def _sums(xt: np.ndarray, ones_x: np.ndarray, c: np.ndarray) -> tuple[float, np.ndarray]:
    """Of rows (as columns ``xt``, and as rows behind a one): the sum of the least |c|^2 - 2 c.x, and per centre its rows
    and coordinate sums (ties: the first centre)."""
    gap = (-2.0 * c) @ xt
    gap += (c ** 2).sum(axis=1)[:, None]
    least = gap[0].copy()
    at = np.zeros(len(least), np.int32)
    for j in range(1, len(c)):
        at[gap[j] < least] = j
        np.minimum(least, gap[j], out=least)
    own = (at[None, :] == np.arange(len(c), dtype=np.int32)[:, None]).astype(float)
    return float(least.sum()), own @ ones_x


def _assigned(centres: list[np.ndarray], live: list[int]):
    """Per start: inertia, then rows and coordinate sums of each centre, of a task's rows."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
            xt, ones_x = np.ascontiguousarray(x.T), np.hstack([np.ones((len(x), 1)), x])
            size = (x ** 2).sum()
            for i in live:
                least, s = _sums(xt, ones_x, centres[i])
                part = np.concatenate([[max(size + least, 0.0)], s[:, 0], s[:, 1:].ravel()])
                total[i] = total[i] + part if i in total else part
        if total:
            yield pa.RecordBatch.from_pydict({"start": pa.array(list(total)), "s": pa.array(list(total.values()))})
    return run


def _blocked(centres: list[np.ndarray], live: list[int], d: int):
    """As ``_assigned`` over blocks of rows; in place of the inertia 0."""
    from quarry.operators import blocks

    def own(x, c):
        return _sums(np.ascontiguousarray(x.T), np.hstack([np.ones((len(x), 1)), x]), c)[1]

    def run(batches):
        groups = {k: [i for i in live if len(centres[i]) == k] for k in sorted({len(centres[i]) for i in live})}
        total: dict[int, np.ndarray] = {}
        for x, *leaves in blocks.pieces(batches, d):
            for k, starts_ in groups.items():
                got = blocks.sums(x, *leaves, np.stack([centres[i] for i in starts_]), own)
                total[k] = total[k] + got if k in total else got
        if total:
            yield pa.RecordBatch.from_pydict({
                "start": pa.array([i for k in total for i in groups[k]]),
                "s": pa.array([np.concatenate([[0.0], g[:, 0], g[:, 1:].ravel()]) for got in total.values() for g in got])})
    return run


def lloyd(vec: DataFrame, begin: list[np.ndarray], max_iter: int = 500) -> list[tuple[np.ndarray, float]]:
    """(centres, inertia) that each start comes to."""
    rows = vec.select(vector_to_array("features").alias("x"))
    count = rows.count()
    size = 0.0
    if count > BLOCK_ROWS:
        from quarry.operators import blocks
        d = begin[0].shape[1]
        size = rows.select(F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()[0]
        rows = blocks.blocks(rows, count, d).persist()
    else:
        rows = dealt(rows, count).persist()
    centres, inertia = [c.copy() for c in begin], [float("inf")] * len(begin)
    live = list(range(len(begin)))
    for _ in range(max_iter + 1):
        step = _blocked(centres, live, d) if count > BLOCK_ROWS else _assigned(centres, live)
        got = (rows.mapInArrow(step, "start long, s array<double>").groupBy("start")
               .agg(Summarizer.sum(array_to_vector("s")).alias("s")).collect())
        still = []
        for r in got:
            i, s = r["start"], np.asarray(r["s"].toArray())
            k, d = centres[i].shape
            n, sums = s[1:k + 1], s[k + 1:].reshape(k, d)
            # over blocks: the squares of the rows plus n |c|^2 - 2 c.sum of each centre
            inertia[i] = max(float(size + (n * (centres[i] ** 2).sum(axis=1)).sum() - 2 * (centres[i] * sums).sum()), 0.0) if count > BLOCK_ROWS else float(s[0])
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[i])
            if ((new - centres[i]) ** 2).sum() > TOLERANCE:
                centres[i] = new
                still.append(i)
        live = sorted(still)
        if not live:
            break
    rows.unpersist()
    return list(zip(centres, inertia))


def refined(rows: DataFrame, begin: list[np.ndarray], max_iter: int = 20, tol: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """(centres, inertia) of every start by the rules of Spark's KMeans, all starts in the same passes: centres
    move in every step, a start ends when none moved by more than ``tol``, and its inertia is that before the last
    move. ``rows``: vectors as arrays x, cached by the caller."""
    centres, inertia = [c.copy() for c in begin], [0.0] * len(begin)
    live = list(range(len(begin)))
    for _ in range(max_iter):
        got = (rows.mapInArrow(_assigned(centres, live), "start long, s array<double>").groupBy("start")
               .agg(Summarizer.sum(array_to_vector("s")).alias("s")).collect())
        still = []
        for r in got:
            i, s = r["start"], np.asarray(r["s"].toArray())
            k, d = centres[i].shape
            n, sums = s[1:k + 1], s[k + 1:].reshape(k, d)
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[i])
            if (((new - centres[i]) ** 2).sum(axis=1) > tol ** 2).any():
                still.append(i)
            centres[i], inertia[i] = new, float(s[0])
        live = sorted(still)
        if not live:
            break
    return list(zip(centres, inertia))


def _labels(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row (ties: the first), by the sums of ``nearest``."""
    least, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for i, c in enumerate(centres):
        gap = np.zeros(len(x))
        for j, v in enumerate(c):
            gap += (x[:, j] - v) * (x[:, j] - v)
        at[gap < least] = i
        np.minimum(least, gap, out=least)
    return at


def _columns(batch) -> np.ndarray:
    return np.stack([np.asarray(c) for c in batch.columns], axis=1)


def merged_small(sizes: np.ndarray, min_share: float) -> np.ndarray:
    """The label that each centre's rows bear once those of small clusters bear the lowest-numbered one that is not
    small (``segment.rebalance``)."""
    own = np.arange(len(sizes))
    valid = [i for i in own if 0 < sizes[i] >= int(sizes.sum() * min_share)]
    return np.where((sizes > 0) & (sizes < int(sizes.sum() * min_share)), valid[0], own) if valid else own


def silhouettes(rows: DataFrame, found: dict, min_share: float) -> dict:
    """{key of ``found``: (label of each centre, rows of each label, silhouette)} of all clusterings of the rows (plain columns of
    features, cached by the caller): labels and their sums in one pass, the mean silhouette by squared distances (as
    Spark's ClusteringEvaluator has it) in a second. None in its place where one label is left."""
    keys = list(found)
    centres = [np.asarray(found[key][0]) for key in keys]

    def sums(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _columns(batch)
            v = np.hstack([np.ones((len(x), 1)), x, (x ** 2).sum(axis=1)[:, None]])
            got = []
            for c in centres:
                at = _labels(x, c)
                got.append(((at[None, :] == np.arange(len(c))[:, None]).astype(float) @ v).ravel())
            got = np.concatenate(got)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_pydict({"s": pa.array([total.tolist()], pa.list_(pa.float64()))})

    d = len(rows.columns)
    whole = np.sum([r["s"] for r in rows.mapInArrow(sums, "s array<double>").collect()], axis=0)
    says, stats, begin = [], [], 0
    for c in centres:
        per = whole[begin:begin + len(c) * (d + 2)].reshape(len(c), d + 2)
        begin += len(c) * (d + 2)
        label = merged_small(per[:, 0], min_share)
        says.append(label)
        stats.append(np.stack([per[label == j].sum(axis=0) for j in range(len(c))]))

    def score(batches):
        total = np.zeros(len(centres))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _columns(batch)
            size = (x ** 2).sum(axis=1)
            for i, (c, label, per) in enumerate(zip(centres, says, stats)):
                names = np.flatnonzero(per[:, 0])
                if len(names) < 2:
                    continue
                n = per[names, 0]
                far = size + (per[names, -1] / n)[:, None] - 2 * ((per[names, 1:-1] / n[:, None]) @ x.T)
                at = np.searchsorted(names, label[_labels(x, c)])
                line = np.arange(len(x))
                own = far[at, line] * n[at] / np.maximum(n[at] - 1, 1)
                far[at, line] = np.inf
                other = far.min(axis=0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = np.where(own < other, 1 - own / other, np.where(own > other, other / own - 1, 0.0))
                total[i] += np.where(n[at] == 1, 0.0, s).sum()
        yield pa.RecordBatch.from_pydict({"s": pa.array([total.tolist()], pa.list_(pa.float64()))})

    score_sums = np.sum([r["s"] for r in rows.mapInArrow(score, "s array<double>").collect()], axis=0)
    return {key: (says[i], stats[i][:, 0].astype(int), float(score_sums[i] / stats[i][:, 0].sum()) if (stats[i][:, 0] > 0).sum() > 1 else None)
            for i, key in enumerate(keys)}


def _distances(centres: list[np.ndarray]):
    """mapInArrow body: (start, centre, its rows, the sum of their distances to it) of a task's rows."""
    def run(batches):
        size, far = [np.zeros(len(c), np.int64) for c in centres], [np.zeros(len(c)) for c in centres]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
            for i, c in enumerate(centres):
                gaps = np.stack([((x - v) ** 2).sum(axis=1) for v in c])
                at = gaps.argmin(axis=0)
                size[i] += np.bincount(at, minlength=len(c))
                far[i] += np.bincount(at, np.sqrt(gaps.min(axis=0)), len(c))
        own = [(i, j) for i, c in enumerate(centres) for j in range(len(c)) if size[i][j]]
        yield pa.RecordBatch.from_pydict({
            "start": pa.array([i for i, _ in own], pa.int32()), "centre": pa.array([j for _, j in own], pa.int32()),
            "size": pa.array([int(size[i][j]) for i, j in own], pa.int64()), "far": pa.array([float(far[i][j]) for i, j in own], pa.float64())})
    return run


def spreads(rows: DataFrame, centres: list[np.ndarray]) -> list[dict[int, tuple[int, float]]]:
    """Per start {centre: (rows nearest to it, their mean distance)}, of all starts in one pass."""
    out: list[dict[int, tuple[int, float]]] = [{} for _ in centres]
    for r in (rows.mapInArrow(_distances(centres), "start int, centre int, size long, far double").groupBy("start", "centre")
              .agg(F.sum("size").alias("size"), F.sum("far").alias("far")).collect()):
        out[r["start"]][r["centre"]] = r["size"], r["far"] / r["size"]
    return out


def best_of(vec: DataFrame, ks: list[int], seeds: tuple[int, ...] = (42, 59, 76), n_init: int = 15, max_iter: int = 500) -> dict:
    """{(k, seed): (centres, inertia)}: of each seed's starts the one of least inertia (ties: the first)."""
    begun = starts(vec, ks, seeds, n_init)
    out: dict = {}
    for (k, seed, _), (centres, inertia) in zip(begun, lloyd(vec, [c for _, _, c in begun], max_iter)):
        if (k, seed) not in out or inertia < out[k, seed][1]:
            out[k, seed] = centres, inertia
    return out


def nearest(centres: np.ndarray, features: str = "features", plain: list[str] | None = None) -> Column:
    """Number of the nearest centre (ties: the first); of the columns ``plain`` where the features are such."""
    x = [F.col(c) for c in plain] if plain else vector_to_array(features)
    gaps = F.array(*[sum(((x[j] - F.lit(float(v))) * (x[j] - F.lit(float(v))) for j, v in enumerate(c)), F.lit(0.0)) for c in centres])
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")
