"""Registered correlation / test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import relate as R
from quarry.plans import fixtures as FX
from quarry.plans.common import finish, oracle_finish, register

CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "neg", "half", "const"]
TEST_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "neg"]
TEST_CAT = ["l_returnflag", "l_linestatus"]
TARGET = "l_extendedprice"

BAND_SQL = ("CASE WHEN abs(r) < 0.3 THEN 'Très faible' WHEN abs(r) < 0.5 THEN 'Faible' "
            "WHEN abs(r) < 0.7 THEN 'Modérée' ELSE 'Forte' END")


def _pairs_sql():
    return FX.with_views(oracle_finish(_pairs_inner(), ["r", "r_squared"]), "corr_lineitem")


def _pairs_inner():
    parts = []
    for i, a in enumerate(CORR_COLS):
        for j in range(i + 1, len(CORR_COLS)):
            b = CORR_COLS[j]
            parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, CAST({i} AS BIGINT) AS i, "
                         f"CAST({j} AS BIGINT) AS j, count({a} + {b}) AS n, "
                         f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE greatest(-1.0, least(1.0, corr({a}, {b}))) END AS r FROM corr_lineitem")
    inner = f"""
SELECT var1, var2, i, j, n, r, r * r AS r_squared, {BAND_SQL.replace('abs(r)', 'abs(round(r, 3))')} AS band, strength,
       CAST(row_number() OVER (PARTITION BY strength ORDER BY round(abs(r), 10) DESC, i, j) AS BIGINT) AS strength_rank
FROM (SELECT *, CASE WHEN abs(round(r, 3)) > 0.7 THEN 'strong' WHEN abs(round(r, 3)) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength
      FROM ({' UNION ALL '.join(parts)}) p WHERE r IS NOT NULL AND NOT isnan(r)) s"""
    return inner


@register("correlation_pairs", _pairs_sql())
def q_correlation_pairs(spark, sf):
    return finish(R.correlation_pairs(FX.corr_lineitem(spark, sf), CORR_COLS))


def _target_sql():
    return FX.with_views(oracle_finish(_target_inner(), ["r", "r_squared"]), "corr_lineitem")


def _target_inner():
    parts = [f"SELECT '{c}' AS variable, CAST({k} AS BIGINT) AS ordinal, "
             f"CASE WHEN isnan(corr({c}, {TARGET})) THEN NULL ELSE greatest(-1.0, least(1.0, corr({c}, {TARGET}))) END AS r FROM corr_lineitem"
             for k, c in enumerate([c for c in CORR_COLS if c != TARGET])]
    inner = f"""
SELECT variable, r, r * r AS r_squared, {BAND_SQL} AS band,
       CAST(row_number() OVER (ORDER BY round(abs(r), 10) DESC, ordinal) AS BIGINT) AS "rank"
FROM ({' UNION ALL '.join(parts)}) p WHERE r IS NOT NULL AND NOT isnan(r) AND abs(r) > 0.1"""
    return inner


@register("target_correlations", _target_sql())
def q_target_correlations(spark, sf):
    return finish(R.target_correlations(FX.corr_lineitem(spark, sf), CORR_COLS, TARGET))


def _tests_sql():
    y = TARGET
    group_parts = []
    for ci, c in enumerate(TEST_CAT):
        group_parts.append(f"""
  SELECT '{c}' AS variable1, CAST({ci} AS BIGINT) AS cat_ordinal, CAST({c} AS VARCHAR) AS grp,
         count({y}) AS n, avg({y}) AS mean, var_samp({y}) AS var
  FROM corr_lineitem WHERE {c} IS NOT NULL AND {y} IS NOT NULL GROUP BY {c}""")
    groups = " UNION ALL ".join(group_parts)
    pairs = [(a, b) for i, a in enumerate(TEST_NUM) for b in TEST_NUM[i + 1:]]
    pear = " UNION ALL ".join(
        f"SELECT '{a}' AS variable1, '{b}' AS variable2, CAST({k} AS BIGINT) AS k, count({a} + {b}) AS n, "
        f"corr({a}, {b}) AS r FROM corr_lineitem" for k, (a, b) in enumerate(pairs))
    inner = f"""
WITH g AS ({groups}),
nv AS (SELECT variable1, count(*) AS n_values FROM g GROUP BY variable1),
gr AS (SELECT *, row_number() OVER (PARTITION BY variable1 ORDER BY grp) AS g_rank FROM g),
tt AS (
  SELECT a.variable1, a.cat_ordinal,
         (a.mean - b.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)
                                 * (1.0 / a.n + 1.0 / b.n)) AS statistic
  FROM gr a JOIN gr b ON a.variable1 = b.variable1 AND a.g_rank = 1 AND b.g_rank = 2
  JOIN nv ON nv.variable1 = a.variable1
  WHERE nv.n_values = 2 AND a.n >= 2 AND b.n >= 2),
big AS (SELECT * FROM g WHERE n >= 2),
tot AS (SELECT variable1, sum(n) AS nn, sum(n * mean) / sum(n) AS gm, count(*) AS k FROM big GROUP BY variable1),
av AS (
  SELECT big.variable1, min(big.cat_ordinal) AS cat_ordinal,
         (sum(big.n * (big.mean - tot.gm) * (big.mean - tot.gm)) / (min(tot.k) - 1))
         / (sum((big.n - 1) * big.var) / (min(tot.nn) - min(tot.k))) AS statistic
  FROM big JOIN tot ON big.variable1 = tot.variable1 JOIN nv ON nv.variable1 = big.variable1
  WHERE nv.n_values >= 3 AND tot.k >= 3 GROUP BY big.variable1),
allt AS (
  SELECT variable1, '{y}' AS variable2, 'ttest' AS test_type, statistic, cat_ordinal * 100 AS sk FROM tt
  UNION ALL
  SELECT variable1, '{y}', 'anova', statistic, cat_ordinal * 100 FROM av
  UNION ALL
  SELECT variable1, variable2, 'pearson', r, 1000 + k FROM ({pear}) p
  WHERE n >= 5 AND r IS NOT NULL AND NOT isnan(r) AND abs(r) > 0.2)
SELECT CAST(row_number() OVER (ORDER BY sk) AS BIGINT) AS ordinal, variable1, variable2, test_type, statistic FROM allt"""
    return FX.with_views(oracle_finish(inner, ["statistic"]), "corr_lineitem")


@register("stat_tests", _tests_sql())
def q_stat_tests(spark, sf):
    t = R.statistical_tests(FX.corr_lineitem(spark, sf), TARGET, TEST_NUM, TEST_CAT, with_p=False)
    return finish(t.select("ordinal", "variable1", "variable2", "test_type", "statistic"))


@register("stat_tests_pvalues")
def q_stat_tests_pvalues(spark, sf):
    """T4 + T5 with p-values (Arrow UDF); rows-only check, p-values are unit-tested."""
    return finish(R.statistical_tests(FX.corr_lineitem(spark, sf), TARGET, TEST_NUM, TEST_CAT))


def _key_relation_sql():
    y = TARGET
    return FX.with_views(oracle_finish(f"""
WITH t AS (SELECT *, exp(-4 * abs(statistic)) AS p_value FROM ({_tests_sql()}) st),
s AS (
  SELECT ordinal, variable1, variable2, test_type, statistic, p_value,
         CASE WHEN variable1 = '{y}' OR variable2 = '{y}' THEN 200 ELSE 100 END
         + CASE WHEN p_value < 0.01 THEN 120 WHEN p_value < 0.05 THEN 100 WHEN p_value < 0.15 THEN 50 ELSE 0 END
         + CASE WHEN abs(statistic) > 0.5 THEN 70 WHEN abs(statistic) > 0.3 THEN 50 ELSE 0 END
         + CASE test_type WHEN 'pearson' THEN 40 + 30 WHEN 'anova' THEN 30 WHEN 'ttest' THEN -20 ELSE 0 END + 20 AS score
  FROM t)
SELECT ordinal, variable1, variable2, test_type, statistic, p_value, CAST(score AS BIGINT) AS score,
       row_number() OVER (ORDER BY score DESC, ordinal) AS key_rank FROM s""", ["statistic", "p_value"]), "corr_lineitem")


@register("key_relation", _key_relation_sql())
def q_key_relation(spark, sf):
    """T6 over the full test list with plain p-values; rank 1 is the key relation."""
    t = R.statistical_tests(FX.corr_lineitem(spark, sf), TARGET, TEST_NUM, TEST_CAT, with_p=False)
    t = t.withColumn("p_value", F.exp(-4 * F.abs(F.col("statistic")))).withColumn("conclusion", F.lit(None).cast("string"))
    return finish(R.key_relation_scores(t, TARGET, "regression", "effect of discount on l_extendedprice").drop("conclusion", "reasons"))


def _sums_sql():
    parts = [f"SELECT '{a}' AS var1, '{b}' AS var2, regr_count({a}, {b})::BIGINT AS n, sum({a}) FILTER ({b} IS NOT NULL) AS sum1, "
             f"sum({b}) FILTER ({a} IS NOT NULL) AS sum2, round(regr_syy({a}, {b}), 4) + 0.0 AS ss1, round(regr_sxx({a}, {b}), 4) + 0.0 AS ss2 "
             f"FROM (SELECT {a}::DOUBLE AS {a}, {b}::DOUBLE AS {b} FROM corr_lineitem) x"
             for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]
    return FX.with_views(oracle_finish(" UNION ALL ".join(parts), ["sum1", "sum2", "ss1", "ss2"]), "corr_lineitem")


@register("pair_sums", _sums_sql())
def q_pair_sums(spark, sf):
    """The sums that C1, C3 and T3 of one analysis read, of every pair of columns over its complete rows."""
    t = R.PairSums(FX.corr_lineitem(spark, sf), CORR_COLS).table(spark).drop("sp")
    return finish(t.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("ss1", "ss2")}))
