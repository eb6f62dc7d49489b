"""One Gram matrix for the correlations and Pearson tests of an analysis."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import relate as R


@pytest.fixture(scope="module")
def holes(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        a, b = float(rng.normal(1e6, 1)), float(rng.normal())
        rows.append((a if i % 7 else None, a * 2 + b if i % 5 else float("nan"), b if i % 11 else float("inf"), 4.0,
                     "xyz"[i % 3] if i % 13 else None))
    return spark.createDataFrame(rows, "a double, b double, c double, flat double, g string"), rows


def test_pairs_match_numpy_over_complete_rows(holes):
    df, rows = holes
    s = R.PairSums(df, ["a", "b", "c", "flat"])
    x = np.array([[np.nan if v is None or math.isinf(v) else v for v in r[:4]] for r in rows])
    for i, p in enumerate("abc"):
        for j, q in enumerate("abc"):
            if i < j:
                whole = x[~np.isnan(x[:, i]) & ~np.isnan(x[:, j])]
                n, sa, sb, va, vb, cab = s.sums(p, q)
                assert n == len(whole)
                assert sa == pytest.approx(whole[:, i].sum()) and sb == pytest.approx(whole[:, j].sum())
                assert va == pytest.approx(((whole[:, i] - whole[:, i].mean()) ** 2).sum(), rel=1e-6)
                assert s.r(p, q)[1] == pytest.approx(np.corrcoef(whole[:, i], whole[:, j])[0, 1], abs=1e-8)
    assert s.r("a", "flat")[1] is None


def test_empty_table_and_missing_columns(spark, holes):
    df, _ = holes
    assert R.PairSums(df.limit(0), ["a", "b"]).r("a", "b") == (0, None)
    assert R.PairSums(df, []).table(spark).count() == 0
    only = R.PairSums(df, ["a", "b"])  # does not cover c: a pass of its own
    assert R.pearson_pairs(df, ["a", "c"], only)[0][2:] == R.pearson_pairs(df, ["a", "c"])[0][2:]


def test_analysis_makes_one_pair_pass(spark, holes, monkeypatch):
    from quarry.plans.analysis import complete_analysis
    built, own = [], R.PairSums.__init__
    monkeypatch.setattr(R.PairSums, "__init__", lambda self, *a, **k: (built.append(1), own(self, *a, **k))[1])
    df, _ = holes
    out = complete_analysis(df.select("a", "b", "c", "g"), target="b")
    assert len(built) == 1
    got = {frozenset((r["var1"], r["var2"])): r["r"] for r in out["correlations"].collect()}
    alone = {frozenset((a, b)): r for a, b, _, r in R.pearson_pairs(df, ["a", "b", "c"])}
    assert got and all(got[p] == pytest.approx(alone[p], abs=1e-9) for p in got)


def test_groups_without_a_target_value_still_count(spark):
    """A third category whose targets are all missing makes the column three-valued: no t-test of two groups."""
    rows = [("p", 1.0), ("p", 2.0), ("q", 4.0), ("q", 7.0), ("r", None), (None, 9.0)]
    df = spark.createDataFrame(rows, "g string, y double")
    assert R.group_tests(df, ["g"], "y", with_p=False).count() == 0
    two = R.group_tests(df.filter(F.coalesce("g", F.lit("")) != "r"), ["g"], "y", with_p=False).collect()
    assert [r["test_type"] for r in two] == ["ttest"]
    assert {(r["group"], r["n"]) for r in R.group_moments(df, ["g"], "y").collect()} == {("p", 2), ("q", 2)}


def test_profile_counts_finite_values_only(spark, holes):
    from quarry.operators.profile import column_profile
    df, rows = holes
    got = {r["column"]: r for r in column_profile(df, with_quantiles=False).collect()}
    b = np.array([r[1] for r in rows if math.isfinite(r[1])])
    assert (got["b"]["n"], got["b"]["n_null"]) == (len(b), len(rows) - len(b))
    assert got["b"]["mean"] == pytest.approx(b.mean()) and got["b"]["sd"] == pytest.approx(b.std(ddof=1))
