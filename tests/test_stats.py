"""Unit tests for the statistical building blocks (p-values, quantiles, moments)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quarry.functions.stats import (basic_stats, central_sums, f_upper_p, moments_from_sums, quantiles,
                                    t_two_sided_p)
from quarry.sources.tables import load


def test_f_pvalue_check_value():
    assert f_upper_p(3.09, 2, 100) == pytest.approx(0.04987, abs=2e-5)


def test_t_pvalue_known():
    assert t_two_sided_p(2.0, 10) == pytest.approx(0.0734, abs=1e-4)
    assert t_two_sided_p(0.0, 5) == pytest.approx(1.0)
    assert t_two_sided_p(1.96, 1e6) == pytest.approx(0.05, abs=1e-3)


COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_orderkey"]


@pytest.mark.parametrize("buckets,gather", [(2048, 4096), (16, 50), (4, 10)])
def test_exact_quantiles_by_refinement(spark, buckets, gather):
    li = load(spark, SF_SMALL, "lineitem")
    pdf = li.select(COLS).toPandas()
    q = quantiles(li, COLS, [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0], buckets=buckets, gather_max=gather)
    for c in COLS:
        ref = np.quantile(pdf[c].astype(float), [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0])
        assert np.allclose(ref, q[c], rtol=0, atol=1e-9), c


def test_quantiles_with_nulls(spark):
    li = load(spark, SF_SMALL, "lineitem").select(
        F.when(F.col("l_orderkey") % 3 == 0, None).otherwise(F.col("l_tax")).alias("t"))
    pdf = li.toPandas()
    q = quantiles(li, ["t"], [0.25, 0.5, 0.75], buckets=8, gather_max=20)
    ref = pdf["t"].dropna().quantile([0.25, 0.5, 0.75]).to_numpy()
    assert np.allclose(ref, q["t"], atol=1e-12)


def test_moments_match_pandas(spark):
    li = load(spark, SF_SMALL, "lineitem")
    pdf = li.select(COLS).toPandas()
    bs = basic_stats(li, COLS)
    cs = central_sums(li, COLS, {c: bs[c]["mean"] for c in COLS})
    for i, c in enumerate(COLS):
        m = moments_from_sums(bs[c]["n"], cs[f"m2_{i}"], cs[f"m3_{i}"], cs[f"m4_{i}"])
        s = pdf[c].astype(float)
        assert m["var"] == pytest.approx(s.var(), rel=1e-10)
        assert m["skew"] == pytest.approx(s.skew(), rel=1e-8, abs=1e-12)
        assert m["kurt"] == pytest.approx(s.kurtosis(), rel=1e-8, abs=1e-12)


def test_nan_and_infinity_count_as_missing(spark):
    from quarry.operators.profile import numeric_stats
    df = spark.createDataFrame([(float(i),) for i in range(1, 10)] + [(float("nan"),), (float("inf"),), (None,)], "x double")
    for with_mode in (True, False):
        s = numeric_stats(df, ["x"], with_mode=with_mode)[0]
        assert (s["count"], s["missing"], s["mean"], s["median"], s["max"], s["q1"]) == (9, 3, 5.0, 5.0, 9.0, 3.0)


def test_texts_without_the_shape_of_a_date_are_not_parsed(spark):
    from quarry.operators.profile import DATE_FORMATS, parsed_date
    texts = ["2024-02-29", "29/02/2024", "2023-02-29", "2024-02-29 10:11:12", "29-02-2024", "02/29/2024", "12024-01-01", "+12024-01-01",
             "5-LOW", "", " 2024-02-29", "2024-2-9", "2024-02-29x", None, "99/99/9999", "2024-02-29 24:00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in DATE_FORMATS])
    assert df.filter(~old.eqNullSafe(parsed_date(F.col("t")))).count() == 0
    assert df.filter(parsed_date(F.col("t")).isNotNull()).count() >= 5
    plan = df.select(parsed_date(F.col("t")))._jdf.queryExecution().toString()
    assert plan.lower().count("rlike") >= len(DATE_FORMATS)


def test_quantile_rounds_do_not_multiply_the_rows_by_the_columns(spark):
    """Many columns: a task counts each against its own cells, so no row is unpivoted; values as numpy has them."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 12)) * 10.0 ** np.arange(-3, 9)
    x[::7, 3] = np.nan
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(3)
    plans = []
    frame = type(df)
    mapped = frame.mapInArrow

    def seen(self, *a, **k):
        plans.append(self._jdf.queryExecution().toString())
        return mapped(self, *a, **k)
    frame.mapInArrow = seen
    try:
        got = quantiles(df, names, [0.25, 0.5, 0.9], buckets=16, gather_max=20)
    finally:
        frame.mapInArrow = mapped
    assert plans and not any("Expand" in p for p in plans)
    for i, c in enumerate(names):
        assert np.allclose(got[c], np.nanquantile(x[:, i], [0.25, 0.5, 0.9]), rtol=1e-12)
