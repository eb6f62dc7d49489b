"""Property checks from definitions: counts add up, ranges hold, operators are idempotent."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, SF_TINY
from quarry.operators import clean as C
from quarry.operators import forge as G
from quarry.operators import prepare as PR
from quarry.operators import profile as P
from quarry.operators import segment as K
from quarry.plans import fixtures as FX
from quarry.sources.tables import load, with_row_key


def test_histogram_counts_sum_to_n(spark):
    li = load(spark, SF_SMALL, "lineitem")
    h = P.histogram(li, ["l_quantity", "l_extendedprice"]).groupBy("column").agg(F.sum("n").alias("s")).collect()
    assert all(r["s"] == li.count() for r in h)


def test_pie_pct_sums_to_100(spark):
    p = P.pie(load(spark, SF_SMALL, "orders"), ["o_orderstatus", "o_orderpriority"])
    for r in p.groupBy("column").agg(F.sum("pct").alias("s")).collect():
        assert r["s"] == pytest.approx(100.0)


def test_minmax_in_unit_interval(spark):
    li = load(spark, SF_SMALL, "lineitem")
    out = PR.minmax_scale(li, ["l_quantity", "l_tax"])
    r = out.agg(F.min("l_quantity"), F.max("l_quantity"), F.min("l_tax"), F.max("l_tax")).first()
    assert r[0] == 0.0 and r[1] == 1.0 and r[2] == 0.0 and r[3] == 1.0


def test_standardized_mean_zero_sd_one(spark):
    li = with_row_key(load(spark, SF_SMALL, "lineitem").select("l_quantity", "l_discount"))
    vec, _ = K.standardize(li, ["l_quantity", "l_discount"], "row_key")
    from pyspark.ml.functions import vector_to_array
    a = vec.select(vector_to_array("features").alias("a"))
    r = a.agg(F.avg(F.col("a")[0]), F.stddev_pop(F.col("a")[0])).first()
    assert abs(r[0]) < 1e-9 and r[1] == pytest.approx(1.0, abs=1e-9)


def test_rebalanced_sizes_sum_to_n(spark):
    li = load(spark, SF_SMALL, "lineitem").select(F.col("l_linenumber").alias("cluster"))
    out = K.rebalance(li, "cluster", 0.05)
    assert out.count() == li.count()
    sizes = {r[0]: r[1] for r in out.groupBy("cluster").count().collect()}
    assert min(sizes.values()) >= int(0.05 * li.count())


def test_dedupe_idempotent(spark):
    d, _ = C.dedupe(FX.dup_orders(spark, SF_TINY))
    d2, _ = C.dedupe(d)
    assert d.count() == d2.count() == load(spark, SF_TINY, "orders").count()


def test_clean_is_idempotent(spark):
    once = C.null_tokens_to_null(FX.dirty_customer(spark, SF_TINY))
    twice = C.null_tokens_to_null(once)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_correlations_bounded(spark):
    from quarry.operators.relate import correlation_pairs
    t = correlation_pairs(FX.corr_lineitem(spark, SF_TINY), ["l_quantity", "l_extendedprice", "net", "neg"])
    assert t.filter(F.abs("r") > 1).count() == 0


def test_group_means_match_groupby(spark):
    o = load(spark, SF_TINY, "orders")
    out, _ = G.group_mean_features(o, ["o_totalprice"], ["o_orderstatus"])
    ref = {r[0]: r[1] for r in o.groupBy("o_orderstatus").agg(F.avg("o_totalprice")).collect()}
    for r in out.select("o_orderstatus", "ototalpr_mean_by_oorderst").distinct().collect():
        assert r[1] == pytest.approx(ref[r[0]])


def test_row_index_is_a_permutation_of_positions(spark):
    from quarry.operators.prepare import row_index
    li = load(spark, SF_TINY, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    idx = row_index(li, F.xxhash64("l_orderkey", "l_linenumber", "l_quantity"), "i")
    n = li.count()
    r = idx.agg(F.count("i"), F.countDistinct("i"), F.min("i"), F.max("i")).first()
    assert (r[0], r[1], r[2], r[3]) == (n, n, 0, n - 1)
    # positions follow the order expression
    pdf = idx.select("i", F.xxhash64("l_orderkey", "l_linenumber", "l_quantity").alias("h")).toPandas()
    assert pdf.sort_values("i")["h"].is_monotonic_increasing
