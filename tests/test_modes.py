"""Modes by a bounded summary: equal to a full count wherever they are claimed, and no shuffle of the values."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.stats import quantiles
from quarry.operators.heavy import modes
from quarry.operators.profile import numeric_stats

NAMES = ["few", "inflated", "unique", "rare", "near", "zipf", "none", "zeros"]


@pytest.fixture(scope="module")
def mixed(spark):
    x = F.col("id")
    noise = F.pmod(F.xxhash64(x), F.lit(100003)).cast("double")
    df = spark.range(0, 40000, 1, 8).select(
        (x % 7).cast("double").alias("few"),
        F.when(x % 5 < 2, F.lit(0.0)).otherwise(x + 0.25).alias("inflated"),
        (x + 0.5).alias("unique"),
        F.when(x % 20000 == 0, F.lit(-3.0)).otherwise(x.cast("double")).alias("rare"),
        F.when(x % 10 == 0, F.lit(9.0)).when((x % 10 == 1) | (x == 2), F.lit(8.0)).otherwise(noise + 10).alias("near"),
        F.floor(F.lit(5000.0) / (1 + F.pmod(F.xxhash64(x, F.lit(1)), F.lit(5000)))).alias("zipf"),
        F.lit(None).cast("double").alias("none"),
        F.when(x % 2 == 0, F.lit(-0.0)).when(x % 3 == 0, F.lit(float("nan"))).otherwise(F.lit(0.0)).alias("zeros"))
    return df.cache()


def brute(df, c):
    seen = Counter(r[0] + 0.0 for r in df.select(c).collect() if r[0] is not None and math.isfinite(r[0]))
    most = max(seen.values(), default=0)
    return (min((v for v, n in seen.items() if n == most), default=None), seen)


@pytest.mark.parametrize("counters", [4, 64, 1024])
def test_proven_modes_are_those_of_a_full_count(mixed, counters):
    got = modes(mixed, NAMES, counters=counters)
    assert got.rows == 40000 and sorted([*got.known, *got.rest]) == sorted(NAMES)
    whole = {}
    for r in got.freq.collect():
        whole.setdefault(r["column"], {})[r["value"]] = r["n"]
    for c in NAMES:
        mode, seen = brute(mixed, c)
        if c in got.known:
            assert got.known[c] == mode, c
        if c in got.whole:
            assert whole.get(c, {}) == dict(seen), c
    assert {"unique", "rare"} <= set(got.rest) and {"none", "zeros", "inflated"} <= set(got.known)
    assert {"none", "zeros"} <= set(got.whole) and "inflated" not in got.whole
    if counters == 64:
        assert got.known["near"] == 8.0 and "zipf" in got.known  # two close values, settled by counting
    got.release()


def test_close_values_beyond_the_limit_are_left_to_the_full_count(mixed):
    got = modes(mixed, ["near"], counters=64, close=1)
    assert got.rest == ["near"]
    got.release()


def test_summary_does_not_grow_with_unique_values(mixed):
    got = modes(mixed, ["unique"], counters=64)
    assert got.sums.count() == 2 and got.rest == ["unique"]  # the error and the rows
    got.release()


def test_statistics_equal_those_of_scans(mixed):
    a = {s["column"]: s for s in numeric_stats(mixed, NAMES, with_mode=True)}
    b = {s["column"]: s for s in numeric_stats(mixed, NAMES, with_mode=False)}
    assert list(a) == list(b) == [c for c in NAMES if c != "none"]
    for c in a:
        assert a[c]["mode"] == brute(mixed, c)[0], c
        for k in set(a[c]) - {"mode", "column"}:
            if b[c][k] is None:  # no skewness of a constant
                assert a[c][k] is None, (c, k)
            else:
                assert a[c][k] == pytest.approx(b[c][k], rel=1e-9, abs=1e-9), (c, k)


def test_empty_table(spark, mixed):
    got = modes(mixed.limit(0), ["few", "unique"])
    assert got.rows == 0 and got.known == {"few": None, "unique": None} and got.rest == []
    got.release()
    assert numeric_stats(mixed.limit(0), ["few", "unique"]) == []


@pytest.mark.parametrize("buckets", [8, 256])
def test_quantiles_of_the_whole_range_of_doubles(spark, buckets):
    """Widths that overflow and values over 600 orders of magnitude, of both signs."""
    rng = np.random.default_rng(5)
    x = np.concatenate([[-1.7e308, 1.7e308, 5e-324, -5e-324, 0.0, -0.0],
                        10.0 ** rng.uniform(-300, 300, 300), -(10.0 ** rng.uniform(-300, 300, 200)), np.full(150, 3.0)])
    df = spark.createDataFrame([(float(v),) for v in rng.permutation(x)], "x double")
    probs = [0.0, 0.05, 0.3, 0.5, 0.65, 0.9, 1.0]
    got = quantiles(df, ["x"], probs, buckets=buckets, gather_max=20)["x"]
    s = np.sort(x)
    for p, v in zip(probs, got):
        h = (len(s) - 1) * p
        lo = int(h)
        want = s[lo] * (1 - (h - lo)) + s[min(lo + 1, len(s) - 1)] * (h - lo)
        assert v == pytest.approx(want, rel=1e-12), p
