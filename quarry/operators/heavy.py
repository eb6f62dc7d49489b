"""Modes of columns without a shuffle of their values: a mergeable counter summary and its proof.

A task counts the values of every column in at most 2 x ``counters`` counters. When a column has more, the
count of rank ``counters`` + 1 is taken off all of them and those at nothing go; at its end the task sends only
values that hold more than one row in ``counters``, and the largest count it kept back. What it has taken off is the column's error: a value's
true count lies between the sum of its sent counts and that sum plus the errors of all tasks.

The value with the largest sum wins over every value whose sum is smaller by more than the error, and over every value
that nobody sent if it exceeds the error. Values that stay close are counted exactly by one more scan. A column
where the proof fails (its mode is rare) is left to the caller, who has to let all values meet: two equal values in two tasks
cannot be told from unequal ones otherwise. A column without any error is known whole, with all its frequencies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.stats import finite

#: Counters that a task keeps of a column, and values of a column that are counted exactly to settle its mode.
COUNTERS, CLOSE = 1024, 4096


@dataclass
class Modes:
    """What one pass told. ``known``: column to mode (None for a column without values), all of ``whole`` included;
    ``whole``: columns whose complete frequencies stand in ``freq`` (column, value, n); ``rest``: columns to be counted in full."""
    rows: int
    known: dict[str, float | None]
    whole: list[str]
    rest: list[str]
    freq: DataFrame
    sums: DataFrame

    def release(self) -> None:
        self.sums.unpersist()


def _summary(counters: int, width: int):
    """mapInArrow body: (at, value, n) of one task; a null value carries the error, at -1 the rows."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        held = [[] for _ in range(width)]
        size, error, rows = [0] * width, [0] * width, 0

        def fold(i):
            if not held[i]:
                return np.zeros(0), np.zeros(0, np.int64)
            t = pa.table({"v": pa.concat_arrays([v for v, _ in held[i]]), "n": pa.concat_arrays([n for _, n in held[i]])})
            t = t.group_by("v").aggregate([("n", "sum")])
            v, n = t["v"].to_numpy(), t["n_sum"].to_numpy().astype(np.int64)
            if len(n) > 2 * counters:
                cut = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])
                error[i] += cut
                v, n = v[n > cut], n[n > cut] - cut
            held[i], size[i] = [(pa.array(v, pa.float64()), pa.array(n, pa.int64()))], len(n)
            return v, n

        for batch in batches:
            rows += batch.num_rows
            for i, column in enumerate(batch.columns):
                got = pc.value_counts(column.drop_null())
                held[i].append((got.field(0), got.field(1)))
                size[i] += len(got)
                if size[i] > 16 * counters:
                    fold(i)
        at, value, n = [-1], [None], [rows]
        for i in range(width):
            v, c = fold(i)
            few = c <= rows // counters
            if few.any():
                error[i] += int(c[few].max())
                v, c = v[~few], c[~few]
            at += [i] * (len(c) + 1)
            value += [*v.tolist(), None]
            n += [*c.tolist(), error[i]]
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "value": pa.array(value, pa.float64()),
                                          "n": pa.array(n, pa.int64())})
    return run


def modes(df: DataFrame, cols: list[str], counters: int = COUNTERS, close: int = CLOSE) -> Modes:
    """The exact mode (ties to the smallest value; nulls, NaN and infinities are no values) of every numeric column where
    a bounded summary proves it. Shuffles at most ``counters`` rows a task and column, none for unique values.

    An empty table or column has the mode None. ``release()`` frees the summary."""
    from quarry.operators.profile import spread
    # a zero is added so that -0.0 and 0.0 are one value, as they are to groupBy
    x = spread(df.select(*[(finite(F.col(f"`{c}`")) + F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(cols)]))
    sums = (x.mapInArrow(_summary(counters, len(cols)), "at int, value double, n long")
            .groupBy("at", "value").agg(F.sum("n").alias("n")).persist())
    told = {r["at"]: r for r in sums.groupBy("at").agg(
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("best"),
        F.max(F.when(F.col("value").isNull(), F.col("n"))).alias("error")).collect()}
    best = {i: (told[i]["best"] or 0) if i in told else 0 for i in range(len(cols))}
    error = {i: (told[i]["error"] or 0) if i in told else 0 for i in range(len(cols))}
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("at") + 1)
    whole = [c for i, c in enumerate(cols) if not error[i]]
    freq = (sums.filter((F.col("at") >= 0) & F.col("value").isNotNull()).select(name.alias("column"), "value", "n")
            .filter(F.col("column").isin(whole)))

    proven = [i for i in best if best[i] > error[i]]
    least = F.lit(None).cast("long")
    for i in proven:
        least = F.when(F.col("at") == i, F.lit(best[i] - error[i])).otherwise(least)
    near = sums.filter(F.col("value").isNotNull() & (F.col("n") >= least))
    first = F.min_by("value", F.struct((-F.col("n")).alias("nn"), F.col("value").alias("v"))).alias("mode")
    led = {r["at"]: r for r in near.groupBy("at").agg(F.count(F.lit(1)).alias("k"), first).collect()} if proven else {}
    known = {c: None for i, c in enumerate(cols) if not error[i] and not best[i]}
    known |= {cols[i]: r["mode"] for i, r in led.items() if not error[i] or r["k"] == 1}
    unsettled = [i for i, r in led.items() if error[i] and 1 < r["k"] <= close]
    if unsettled:  # at most ``close`` values a column are broadcast
        wanted = F.broadcast(near.filter(F.col("at").isin(unsettled)).select("at", "value"))
        long = (x.select(*[F.col(f"c{i}").alias(str(i)) for i in unsettled]).unpivot([], [str(i) for i in unsettled], "at", "value")
                .withColumn("at", F.col("at").cast("int")))
        counted = long.join(wanted, ["at", "value"]).groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"))
        known |= {cols[r["at"]]: r["mode"] for r in counted.groupBy("at").agg(first).collect()}
    rows = told[-1]["error"] if -1 in told else 0
    return Modes(rows, known, whole, [c for c in cols if c not in known], freq, sums)
