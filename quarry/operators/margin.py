"""Linear support vector machine on Spark by Newton's method, for many problems at once.

Loss: the hinge, rounded by a parabola on the last ROUND of the margin (so that it has a curvature), weighted by
row, plus the usual penalty 1 / (2 C) of the coefficients without the intercept. Each step is one pass over the rows that
sums loss, gradient and curvature of every problem (a class, a C, a fold that is left out) inside tasks and adds
them up by a vector aggregate, so the driver sees (features + 1)^2 numbers a problem whatever the rows. A step that
does not lower the loss is halved. The loss is convex and Newton's steps settle in some ten passes; PASSES bounds them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUND, PASSES, CLOSE = 0.5, 40, 1e-7
#: Rows of the sample on which the steps begin where there are SAMPLED times as many: it only decides where the search over all rows starts.
BEGIN, SAMPLED = 50_000, 8


def _blocks(batches):
    for batch in batches:
        if batch.num_rows:
            col = batch.column("x")
            x = np.asarray(col.flatten()).reshape(batch.num_rows, -1)
            yield (np.hstack([x, np.ones((len(x), 1))]), np.asarray(batch.column("y")), np.asarray(batch.column("w")),
                   np.asarray(batch.column("fold")))


def _sums(problems, at: np.ndarray):
    """(problem, loss and gradient and curvature as one list) of a task's rows."""
    def run(batches):
        total = None
        for x, y, w, fold in _blocks(batches):
            d = x.shape[1]
            if total is None:
                total = np.zeros((len(problems), 1 + d + d * d))
            for i, (c, _, out) in enumerate(problems):
                side = np.where(y == c, 1.0, -1.0)
                weight = np.where(fold == out, 0.0, w)
                short = 1.0 - side * (x @ at[i])
                inner = (short > 0) & (short < ROUND)
                loss = np.where(inner, short ** 2 / (2 * ROUND), np.maximum(short - ROUND / 2, 0))
                slope = -side * weight * np.where(inner, short / ROUND, short >= ROUND)
                total[i, 0] += weight @ loss
                total[i, 1:d + 1] += x.T @ slope
                total[i, d + 1:] += ((x * (weight * inner / ROUND)[:, None]).T @ x).ravel()
        if total is not None:
            yield pa.RecordBatch.from_pydict({"p": pa.array(np.arange(len(problems))), "s": pa.array(list(total))})
    return run


def prepared(rows: DataFrame, label: str = "__y", weight: str = "__w", fold: str | None = None) -> DataFrame:
    """(x, y, w, fold) of rows with a vector ``features``."""
    return rows.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"),
                       (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"))


def solve(rows: DataFrame, problems: list[tuple[float, float, int]], n_features: int, n: int = 0) -> np.ndarray:
    """Coefficients and intercept (last) of each problem (class against the rest, C, fold left out or -2).
    ``rows``: as ``prepared``, cached by the caller; ``n``, their number, lets many of them begin at the solution of a
    sample. The loss is convex, so the start changes the passes and not where they end (to CLOSE)."""
    d = n_features + 1
    ridge = np.array([[1.0 / c] * n_features + [0.0] for _, c, _ in problems])
    at, best = np.zeros((len(problems), d)), np.full(len(problems), np.inf)
    if n > BEGIN * SAMPLED:
        step_ = n // BEGIN
        some = rows.filter(F.pmod(F.xxhash64("x", "y"), F.lit(step_)) == 0).withColumn("w", F.col("w") * F.lit(float(step_))).coalesce(8).persist()
        at = solve(some, problems, n_features)
        some.unpersist()
    kept, step = at.copy(), np.zeros_like(at)
    open_ = np.ones(len(problems), bool)
    for _ in range(PASSES):
        got = rows.mapInArrow(_sums(problems, at), "p long, s array<double>").groupBy("p").agg(Summarizer.sum(array_to_vector("s")).alias("s")).collect()
        for r in got:
            i, s = r["p"], np.asarray(r["s"].toArray())
            if not open_[i]:
                continue
            loss = s[0] + 0.5 * (ridge[i] * at[i] ** 2).sum()
            if loss > best[i]:  # too far: half the step
                step[i] /= 2
                open_[i] = np.abs(step[i]).max() > CLOSE
            else:
                open_[i] = not (best[i] - loss <= CLOSE * max(1.0, abs(loss)))
                best[i], kept[i] = loss, at[i].copy()
                curve = s[d + 1:].reshape(d, d) + np.diag(ridge[i]) + 1e-9 * np.eye(d)
                step[i] = np.linalg.lstsq(curve, s[1:d + 1] + ridge[i] * at[i], rcond=None)[0]
                far = np.abs(step[i]).max()
                step[i] *= min(1.0, 10.0 / far) if far > 0 else 1.0
        if not got or not open_.any():
            break
        at = np.where(open_[:, None], kept - step, kept)
    return kept


class MarginModel(Model):
    """Linear margins of one class against the rest; with two classes of the second."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    @property
    def coefficientMatrix(self):  # as Spark's linear classifiers name it
        from pyspark.ml.linalg import DenseMatrix
        w = self.weights[:, :-1]
        return DenseMatrix(*w.shape, w.ravel().tolist(), True)

    def _transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        margin = [sum((x[j] * F.lit(float(v)) for j, v in enumerate(w[:-1])), F.lit(float(w[-1]))) for w in self.weights]
        if len(margin) == 1:
            return df.withColumn("prediction", F.when(margin[0] > 0, 1.0).otherwise(0.0))
        all_ = F.array(*margin)
        return df.withColumn("prediction", (F.array_position(all_, F.array_max(all_)) - 1).cast("double"))


class LinearMargin(Estimator):
    """Linear support vector machine of penalty ``c`` for ``n_classes`` classes (__y, __w, features)."""

    def __init__(self, n_classes: int, c: float = 0.1):
        super().__init__()
        self.n_classes, self.c = n_classes, c

    def classes(self) -> list[float]:
        return [1.0] if self.n_classes == 2 else [float(i) for i in range(self.n_classes)]

    def _fit(self, df: DataFrame) -> MarginModel:
        rows = prepared(df).persist()
        n, wide = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        weights = solve(rows, [(k, self.c, -2) for k in self.classes()], wide or 0, n)
        rows.unpersist()
        return MarginModel(weights)


def predicted(rows: DataFrame, weights: dict[tuple[int, float], np.ndarray]) -> DataFrame:
    """(c, y, prediction, n) over the held-out rows of every (fold, C), in one pass."""
    def run(batches):
        for x, y, _, fold in _blocks(batches):
            for (f, c), w in weights.items():
                own = fold == f
                margin = x[own] @ w.T
                guess = (margin[:, 0] > 0).astype(float) if w.shape[0] == 1 else margin.argmax(axis=1).astype(float)
                pair, n = np.unique(np.stack([y[own], guess], axis=1), axis=0, return_counts=True)
                if len(n):
                    yield pa.RecordBatch.from_pydict({"fold": pa.array(np.full(len(n), f, np.int32)), "c": pa.array(np.full(len(n), c)),
                                                      "y": pa.array(pair[:, 0]), "prediction": pa.array(pair[:, 1]), "n": pa.array(n)})
    return rows.mapInArrow(run, "fold int, c double, y double, prediction double, n long").groupBy("fold", "c", "y", "prediction").agg(F.sum("n").alias("n"))
