"""Rows in small boxes, so that a k-means step looks at few of them one by one.

Rows are dealt to regions of space (a tree of cuts from a sample, which decides only where rows lie) and, inside a task, to leaves of
LEAF rows by halving the widest side again and again. A leaf knows its rows, their sum, and the middle and half sides of its box. Where
one centre is nearer than every other to the whole box, the leaf counts as one row of that weight; only the rows of leaves that a border
between two centres crosses are looked at. The sums are those over all rows, in every step; the share of crossed leaves falls as
rows grow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a leaf, of a piece (a row of the table of blocks) and of a region; sampled rows that place the regions.
LEAF, PIECE, REGION, PLACED = 64, 65_536, 1_000_000, 16_384


def _tree(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and cut of each inner node of a full tree of ``levels`` levels."""
    dims, cuts = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1)
    held = {0: x}
    for node in range(len(dims)):
        rows = held.pop(node)
        if len(rows):
            dims[node] = np.ptp(rows, axis=0).argmax()
            cuts[node] = np.median(rows[:, dims[node]])
        over = rows[:, dims[node]] > cuts[node]
        held[2 * node + 1], held[2 * node + 2] = rows[~over], rows[over]
    return dims, cuts


def _halved(x: np.ndarray) -> np.ndarray:
    """The order of rows in which each LEAF of them lie close together."""
    order = np.arange(len(x))
    todo = [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= LEAF:
            continue
        own = order[lo:hi]
        part = x[own]
        j = np.ptp(part, axis=0).argmax()
        half = (-(-(hi - lo) // LEAF) // 2) * LEAF
        order[lo:hi] = own[np.argpartition(part[:, j], half - 1)]
        todo += [(lo, lo + half), (lo + half, hi)]
    return order


def _piece(x: np.ndarray) -> tuple[bytes, bytes]:
    """Rows, and per whole leaf its sum, middle and half sides."""
    whole = x[:len(x) // LEAF * LEAF].reshape(-1, LEAF, x.shape[1])
    lo, hi = whole.min(axis=1), whole.max(axis=1)
    return x.tobytes(), np.hstack([whole.sum(axis=1), (lo + hi) / 2, (hi - lo) / 2]).tobytes()


def blocks(rows: DataFrame, n: int, d: int) -> DataFrame:
    """(x, leaves) pieces of the ``n`` rows x of ``d`` numbers."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    levels = max(1, int(np.ceil(np.log2(max(2 * cores, n / REGION)))))
    some = rows.filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, n // PLACED))) == 0).select("x").collect()
    dims, cuts = _tree(np.array([r["x"] for r in some], float).reshape(-1, d), levels)

    def place(batches):
        held, count = [], 0

        def out():
            x = np.concatenate(held)
            at = np.zeros(len(x), np.int64)
            for _ in range(levels):
                at = 2 * at + 1 + (x[np.arange(len(x)), dims[at]] > cuts[at])
            order = np.argsort(at, kind="stable")
            names, first = np.unique(at[order], return_index=True)
            return pa.RecordBatch.from_pydict({"region": pa.array((names - len(dims)).astype(np.int32)),
                                               "x": pa.array([p.tobytes() for p in np.split(x[order], first[1:])], pa.binary())})
        for batch in batches:
            if batch.num_rows:
                held.append(np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, d))
                count += batch.num_rows
            if count >= 4 * PIECE:
                yield out()
                held, count = [], 0
        if held:
            yield out()

    def build(batches):
        held, count = [], 0

        def out():
            x = np.concatenate(held)
            x = x[_halved(x)]
            made = [_piece(x[i:i + PIECE]) for i in range(0, len(x), PIECE)]
            for a, b in made:
                yield pa.RecordBatch.from_pydict({"x": pa.array([a], pa.binary()), "leaves": pa.array([b], pa.binary())})
        for batch in batches:
            for blob in batch.column("x"):
                held.append(np.frombuffer(blob.as_buffer(), float).reshape(-1, d))
                count += len(held[-1])
                if count >= 2 * REGION:
                    yield from out()
                    held, count = [], 0
        if held:
            yield from out()

    placed = rows.select("x").mapInArrow(place, "region int, x binary")
    return placed.repartitionById(1 << levels, F.col("region")).select("x").mapInArrow(build, "x binary, leaves binary")


def pieces(batches, d: int):
    """(rows, leaf sums, middles, half sides) of each piece of a task."""
    for batch in batches:
        for a, b in zip(batch.column("x"), batch.column("leaves")):
            x, leaves = np.frombuffer(a.as_buffer(), float).reshape(-1, d), np.frombuffer(b.as_buffer(), float).reshape(-1, 3 * d)
            yield x, leaves[:, :d], leaves[:, d:2 * d], leaves[:, 2 * d:]


def sums(x: np.ndarray, total: np.ndarray, middle: np.ndarray, half: np.ndarray, centres: np.ndarray, own) -> np.ndarray:
    """For starts of equally many centres (starts x centres x d): per start and centre its rows and their sum. ``own``: that of a few
    rows and one start's centres."""
    starts, k, d = centres.shape
    size = (centres ** 2).sum(axis=2)
    gap = ((-2.0 * centres.reshape(-1, d)) @ middle.T).reshape(starts, k, -1)
    gap += size[:, :, None]
    best, at = gap[:, 0].copy(), np.zeros((starts, gap.shape[2]), np.int64)
    for j in range(1, k):
        at[gap[:, j] < best] = j
        np.minimum(best, gap[:, j], out=best)
    apart = np.sqrt(((centres[:, :, None] - centres[:, None]) ** 2).sum(axis=3))
    line = np.arange(starts)[:, None]
    eps = 1e-9 * (1.0 + np.abs(size).max() + (middle ** 2).sum(axis=1).max(initial=0.0))
    reach = 2 * np.sqrt((half ** 2).sum(axis=1))
    crossed = np.zeros(best.shape, bool)
    for j in range(k):  # by the ball around the box, which is quick
        crossed |= (gap[:, j] - best <= reach * apart[line, at, j] + eps) & (at != j)
    s, l = np.nonzero(crossed)
    a, near, sides = at[s, l], best[s, l], half[l]
    still = np.zeros(len(s), bool)
    for j in range(k):  # what the ball leaves open, by the corners of the box
        still |= (gap[s, j, l] - near <= 2 * (np.abs(centres[s, j] - centres[s, a]) * sides).sum(axis=1) + eps) & (a != j)
    crossed[s, l] = still
    at[crossed] = -1
    leaf = np.hstack([np.full((len(total), 1), float(LEAF)), total])
    out = ((at[:, None, :] == np.arange(k)[None, :, None]).reshape(starts * k, -1).astype(float) @ leaf).reshape(starts, k, d + 1)
    boxes, loose = x[:len(total) * LEAF].reshape(-1, LEAF, d), x[len(total) * LEAF:]
    for s in range(starts):
        few = boxes[crossed[s]].reshape(-1, d)
        if len(loose):
            few = np.concatenate([few, loose])
        if len(few):
            out[s] += own(few, centres[s])
    return out
