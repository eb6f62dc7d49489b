"""Statistical building blocks shared by the profile, relation and model operators.

Everything that touches rows is a Spark aggregate. The only Python on the data path is
the Arrow-batched p-value UDF, which runs on already-aggregated test rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# ---------------------------------------------------------------- moments

def sample_skewness(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness G1 from Spark's population skewness g1 (pandas/DuckDB convention)."""
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis G2 from Spark's population excess kurtosis g2."""
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def finite_or_zero(c: Column) -> Column:
    """NaN / +-Inf / NULL -> 0, as the reference's 'safe' wrapper does for summary values."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


# ---------------------------------------------------------------- quantiles

def finite(c: Column) -> Column:
    """The value as a double; NaN and infinities count as missing (no comparison with them is true)."""
    x = c.cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def _as_double(c: str) -> Column:
    return finite(F.col(f"`{c}`"))


def basic_stats(df: DataFrame, cols: list[str]) -> dict:
    """One code-generated aggregate pass: rows, and per column count / sum / min / max."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        x = _as_double(c)
        aggs += [F.count(x).alias(f"n{i}"), F.sum(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    out = {"__rows": row["__rows"]}
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        out[c] = {"n": n, "sum": row[f"s{i}"], "min": row[f"lo{i}"], "max": row[f"hi{i}"],
                  "mean": (row[f"s{i}"] / n) if n else None}
    return out


def freq_stats(freq: DataFrame, cols: list[str], rows_total: int | None = None) -> dict:
    """basic_stats (plus the mode: most frequent value, ties to the smallest) computed in
    one aggregate over a value-frequency table (column, value, n). When the table keeps
    NULL values, the row total comes from it too."""
    x = F.col("value").cast("double")
    nn = F.col("value").isNotNull()
    res = {r["column"]: r for r in freq.filter(F.col("column").isin(cols)).groupBy("column").agg(
        F.sum("n").alias("total"), F.sum(F.when(nn, F.col("n"))).alias("n"), F.sum(x * F.col("n")).alias("s"),
        F.min(x).alias("lo"), F.max(x).alias("hi"),
        F.min_by(x, F.when(nn, F.struct((-F.col("n")).alias("nn"), x.alias("v")))).alias("mode")).collect()}
    if rows_total is None:
        rows_total = max((r["total"] for r in res.values()), default=0)
    out = {"__rows": rows_total}
    for c in cols:
        r = res.get(c)
        n = (r["n"] or 0) if r else 0
        out[c] = {"n": n, "sum": r["s"] if r else None, "min": r["lo"] if r else None,
                  "max": r["hi"] if r else None, "mean": (r["s"] / n) if n else None,
                  "mode": r["mode"] if r else None}
    return out


def freq_central_sums(freq: DataFrame, cols: list[str], means: dict, fences: dict | None = None) -> dict:
    """central_sums (and optional fence-outlier counts) from a value-frequency table."""
    x = F.col("value").cast("double")
    mean = F.lit(None).cast("double")
    for c in cols:
        mean = F.when(F.col("column") == c, F.lit(means[c] if means[c] is not None else 0.0)).otherwise(mean)
    d = x - mean
    d2 = d * d
    w = F.col("n")
    aggs = [F.sum(w * d2).alias("m2"), F.sum(w * d2 * d).alias("m3"), F.sum(w * d2 * d2).alias("m4")]
    if fences:
        lo = hi = F.lit(None).cast("double")
        for c, (a, b) in fences.items():
            lo = F.when(F.col("column") == c, F.lit(a)).otherwise(lo)
            hi = F.when(F.col("column") == c, F.lit(b)).otherwise(hi)
        aggs.append(F.sum(F.when((x < lo) | (x > hi), w).otherwise(F.lit(0))).alias("out"))
    rows = {r["column"]: r for r in
            freq.filter(F.col("column").isin(cols)).groupBy("column").agg(*aggs).collect()}
    out = {}
    for i, c in enumerate(cols):
        r = rows.get(c)
        out[f"m2_{i}"] = r["m2"] if r else None
        out[f"m3_{i}"] = r["m3"] if r else None
        out[f"m4_{i}"] = r["m4"] if r else None
        if fences:
            out[f"out_{c}"] = r["out"] if r else 0
    return out


def central_sums(df: DataFrame, cols: list[str], means: dict, extra: list[Column] = ()) -> dict:
    """Second pass: sums of (x - mean)^2, ^3, ^4 (the two-pass moment algorithm) plus any
    extra aggregates the caller fuses into the same scan."""
    aggs = list(extra)
    for i, c in enumerate(cols):
        d = _as_double(c) - F.lit(means[c] if means[c] is not None else 0.0)
        d2 = d * d
        aggs += [F.sum(d2).alias(f"m2_{i}"), F.sum(d2 * d).alias(f"m3_{i}"),
                 F.sum(d2 * d2).alias(f"m4_{i}")]
    if not aggs:
        return {}
    return df.agg(*aggs).first().asDict()


def moments_from_sums(n, m2, m3, m4) -> dict:
    """var/sd (ddof 1) and bias-corrected skewness / excess kurtosis (pandas convention)."""
    out = {"var": None, "sd": None, "skew": None, "kurt": None}
    if not n or m2 is None:
        return out
    if n >= 2:
        out["var"] = m2 / (n - 1)
        out["sd"] = math.sqrt(out["var"])
    if m2 <= 0:
        return out
    p2 = m2 / n
    if n >= 3:
        g1 = (m3 / n) / p2 ** 1.5
        out["skew"] = g1 * math.sqrt(n * (n - 1)) / (n - 2)
    if n >= 4:
        g2 = (m4 / n) / (p2 * p2) - 3.0
        out["kurt"] = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return out


def _in_cells(cells, batch):
    """(cell number, the batch's values between the cell's ends); a cell: (column, a, b, ...)."""
    held: dict[int, np.ndarray] = {}
    for i, (at, a, b, *_) in enumerate(cells):
        if at not in held:
            held[at] = batch.column(at).drop_null().to_numpy(zero_copy_only=False)
        x = held[at]
        yield i, x[(x >= a) & (x <= b)]


def _bucket_numbers(x: np.ndarray, a: float, b: float, geometric: bool, buckets: int) -> np.ndarray:
    """As ``bucket_of`` in ``quantiles``."""
    if geometric and a <= 0 <= b:
        return np.where(x < 0, 0, np.where(x == 0, 1, 2))
    if geometric:
        la, lb = math.log(abs(a)), math.log(abs(b))
        if la != lb:
            return np.minimum(np.floor((np.log(np.abs(x)) - la) / (lb - la) * buckets), buckets - 1).astype(np.int64)
    return np.minimum(np.floor((x - a) / (b - a) * buckets), buckets - 1).astype(np.int64)


def _cell_buckets(cells: list[tuple[int, float, float, bool]], buckets: int):
    """mapInArrow body: (cell, bucket, n, mn, mx) of a task's rows for cells (column, a, b, geometric)."""
    def run(batches):
        import pyarrow as pa
        n = [np.zeros(buckets, np.int64) for _ in cells]
        mn, mx = [np.full(buckets, np.inf) for _ in cells], [np.full(buckets, -np.inf) for _ in cells]
        for batch in batches:
            for i, x in _in_cells(cells, batch):
                if len(x):
                    at = np.clip(_bucket_numbers(x, *cells[i][1:], buckets), 0, buckets - 1)
                    n[i] += np.bincount(at, minlength=buckets)
                    np.minimum.at(mn[i], at, x)
                    np.maximum.at(mx[i], at, x)
        for i in range(len(cells)):
            some = np.flatnonzero(n[i])
            if len(some):
                yield pa.RecordBatch.from_pydict({
                    "cell": pa.array(np.full(len(some), i, np.int32)), "bucket": pa.array(some.astype(np.int32)),
                    "n": pa.array(n[i][some]), "mn": pa.array(mn[i][some]), "mx": pa.array(mx[i][some])})
    return run


def _cell_values(cells: list[tuple[int, float, float]]):
    """mapInArrow body: (cell, x, n), the distinct values of small cells (column, a, b) with their rows."""
    def run(batches):
        import pyarrow as pa
        held: list[list] = [[] for _ in cells]
        for batch in batches:
            for i, x in _in_cells(cells, batch):
                if len(x):
                    held[i].append(x)
        for i, xs in enumerate(held):
            if xs:
                x, n = np.unique(np.concatenate(xs), return_counts=True)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(np.full(len(x), i, np.int32)), "x": pa.array(x), "n": pa.array(n)})
    return run


def quantiles(df: DataFrame, cols: list[str], probs: list[float], stats: dict | None = None,
              exact: bool = True, buckets: int = 2048, gather_max: int = 4096,
              accuracy: int = 10_000, freq: DataFrame | None = None) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles (pandas / DuckDB ``quantile_cont``).

    exact=False: one ``percentile_approx`` pass.
    exact=True: selection by histogram refinement. Each round counts the values per (cell,
    equal-width bucket) with count/min/max: a task sums up its columns, each against its own cells
    only, and sends at most cells x buckets rows to the shuffle. The
    bucket holding each wanted rank becomes the next cell ([its min, its max], so bucket
    membership is exact despite floating point). Cells with at most ``gather_max`` values
    are finished by counting their distinct values. Memory per task is bounded by
    buckets / gather_max whatever the data size; rounds grow with log_buckets(n).

    ``freq`` (column, value, n) -- a value-frequency table -- may replace the raw rows; the
    rounds then run over the (usually much smaller, cached) frequency table with weights.
    """
    if not cols:
        return {}
    if not exact:
        row = df.agg(*[F.percentile_approx(_as_double(c), probs, accuracy).alias(f"q{i}")
                       for i, c in enumerate(cols)]).first()
        return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
                for i, c in enumerate(cols)}
    if stats is None:
        stats = basic_stats(df, cols)
    targets = []
    for c in cols:
        n = stats[c]["n"]
        if not n:
            continue
        for p in probs:
            lo = int(math.floor((n - 1) * p))
            targets += [(c, lo), (c, min(lo + 1, n - 1))]
    targets = sorted(set(targets))
    st = {}
    for t in targets:
        s = stats[t[0]]
        st[t] = {"a": s["min"], "b": s["max"], "below": 0, "m": s["n"],
                 "value": s["min"] if s["min"] == s["max"] else None}
    if freq is not None:
        long = (freq.filter(F.col("column").isin(cols) & F.col("value").isNotNull())
                .select("column", F.col("value").cast("double").alias("x"), F.col("n").alias("w")))
    else:
        from quarry.operators.profile import spread
        wide = lambda some: spread(df.select(*[_as_double(c).alias(f"c{i}") for i, c in enumerate(some)]))

    def of_cell(cells, value):
        e = F.lit(None)
        for i, (c, a, b) in reversed(list(enumerate(cells))):
            e = F.when((F.col("column") == c) & (F.col("x") >= F.lit(a)) & (F.col("x") <= F.lit(b)), value(i)).otherwise(e)
        return e

    def bucket_of(a, b, geometric):
        """Buckets that rise with x and part a from b. Equal widths; or, where those leave nearly all values in one
        bucket (or the width overflows), by sign if a and b differ in it, else equal ratios."""
        x = F.col("x")
        if geometric and a <= 0 <= b:
            return F.when(x < 0, F.lit(0)).when(x == 0, F.lit(1)).otherwise(F.lit(2))
        if geometric:
            la, lb = math.log(abs(a)), math.log(abs(b))
            if la != lb:
                part = (F.log(F.abs(x)) - F.lit(la)) / F.lit(lb - la)
                return F.least(F.floor(part * F.lit(buckets)), F.lit(buckets - 1)).cast("int")
        return F.least(F.floor((x - F.lit(a)) / F.lit(b - a) * F.lit(buckets)), F.lit(buckets - 1)).cast("int")

    while True:  # a cell loses its least or its greatest value in every round, a factor of ``buckets`` as a rule
        pending = [t for t in targets if st[t]["value"] is None and st[t]["m"] > gather_max]
        if not pending:
            break
        how = {(t[0], st[t]["a"], st[t]["b"]): st[t].get("geometric", False) or math.isinf(st[t]["b"] - st[t]["a"]) for t in pending}
        cells = sorted(how)
        if freq is not None:
            cid = of_cell(cells, F.lit)
            bucket = of_cell(cells, lambda i: bucket_of(cells[i][1], cells[i][2], how[cells[i]]))
            parts = (long.select(cid.alias("cell"), bucket.alias("bucket"), F.col("w").alias("n"), F.col("x").alias("mn"), F.col("x").alias("mx"))
                     .filter(F.col("cell").isNotNull()))
        else:
            some = list(dict.fromkeys(c for c, _, _ in cells))
            body = _cell_buckets([(some.index(c), a, b, how[c, a, b]) for c, a, b in cells], buckets)
            parts = wide(some).mapInArrow(body, "cell int, bucket int, n long, mn double, mx double")
        rows = (parts.groupBy("cell", "bucket")
                .agg(F.sum("n").alias("n"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))
                .collect())
        per_cell: dict[int, list] = {}
        for r in rows:
            per_cell.setdefault(r["cell"], []).append((r["bucket"], r["n"], r["mn"], r["mx"]))
        for i, (c, a, b) in enumerate(cells):
            bk = sorted(per_cell.get(i, []))
            for t in pending:
                if (t[0], st[t]["a"], st[t]["b"]) != (c, a, b):
                    continue
                kk = t[1] - st[t]["below"]
                acc = 0
                for _, cnt, mn, mx in bk:
                    if acc + cnt > kk:
                        st[t] = {"a": mn, "b": mx, "below": st[t]["below"] + acc, "m": cnt,
                                 "value": mn if mn == mx else None,
                                 "geometric": not how[(c, a, b)] and 4 * cnt > st[t]["m"]}
                        break
                    acc += cnt
    rest = [t for t in targets if st[t]["value"] is None]
    if rest:
        cells = sorted({(t[0], st[t]["a"], st[t]["b"]) for t in rest})
        if freq is not None:
            parts = long.select(of_cell(cells, F.lit).alias("cell"), "x", F.col("w").alias("n")).filter(F.col("cell").isNotNull())
        else:
            some = list(dict.fromkeys(c for c, _, _ in cells))
            parts = wide(some).mapInArrow(_cell_values([(some.index(c), a, b) for c, a, b in cells]), "cell int, x double, n long")
        rows = parts.groupBy("cell", "x").agg(F.sum("n").alias("n")).collect()
        per_cell = {}
        for r in rows:
            per_cell.setdefault(r["cell"], []).append((r["x"], r["n"]))
        for i, cell in enumerate(cells):
            vals = sorted(per_cell.get(i, []))
            for t in rest:
                if (t[0], st[t]["a"], st[t]["b"]) != cell:
                    continue
                kk = t[1] - st[t]["below"]
                acc = 0
                for v, cnt in vals:
                    if acc + cnt > kk:
                        st[t]["value"] = v
                        break
                    acc += cnt
    out = {}
    for c in cols:
        n = stats[c]["n"]
        if not n:
            out[c] = [None] * len(probs)
            continue
        vals = []
        for p in probs:
            h = (n - 1) * p
            lo = int(math.floor(h))
            a = st[(c, lo)]["value"]
            b = st[(c, min(lo + 1, n - 1))]["value"]
            d = h - lo
            vals.append(a * (1.0 - d) + b * d)
        out[c] = vals
    return out


# ---------------------------------------------------------------- p-values
# Regularised incomplete beta by continued fraction; used on aggregated test rows only.

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _betacf(a, b, x, iters: int = 300):
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        delta = d * c
        h = h * delta
        if np.all(np.abs(delta - 1.0) < 3e-16):
            break
    return h


def betainc(a, b, x):
    """I_x(a, b) for arrays; NaN where inputs are invalid."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    a, b, x = np.broadcast_arrays(a, b, x)
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)] = 0.0
    out[ok & (x == 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        am, bm, xm = a[mid], b[mid], x[mid]
        lbt = (_lgamma(am + bm) - _lgamma(am) - _lgamma(bm)
               + am * np.log(xm) + bm * np.log1p(-xm))
        front = np.exp(lbt)
        swap = xm > (am + 1.0) / (am + bm + 2.0)
        res = np.empty_like(xm)
        ns = ~swap
        if ns.any():
            res[ns] = front[ns] * _betacf(am[ns], bm[ns], xm[ns]) / am[ns]
        if swap.any():
            res[swap] = 1.0 - front[swap] * _betacf(bm[swap], am[swap], 1.0 - xm[swap]) / bm[swap]
        out[mid] = res
    return out


def t_two_sided_p(t, dof):
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def f_upper_p(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided Student-t p-value (Arrow batch)."""
    return pd.Series(t_two_sided_p(t.to_numpy(float), dof.to_numpy(float)))


@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper-tail F-distribution p-value (Arrow batch)."""
    return pd.Series(f_upper_p(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))
