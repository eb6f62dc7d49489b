"""Registered profile queries (S7, P9-P14, P16, P22, U1-U6, U8) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import profile as P
from quarry.plans import fixtures as FX
from quarry.plans.common import finish, oracle_finish, register
from quarry.sources.tables import load

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]

SUMMARY_DOUBLES = ['"missing_pct"', '"mean"', '"median"', '"mode"', '"std"', '"var"', '"min"',
                   '"max"', '"q1"', '"q3"', '"iqr"', '"skew"', '"kurtosis"', '"cv"',
                   '"lower_fence"', '"upper_fence"']


def numeric_summary_sql(table: str, cols: list[tuple[str, int]]) -> str:
    parts = []
    for name, ordinal in cols:
        x = f"CAST({name} AS DOUBLE)"
        parts.append(f"""
  SELECT '{name}' AS "column", CAST({ordinal} AS BIGINT) AS ordinal, s.cnt AS "count",
         s.nrows - s.cnt AS missing, 100.0 * (s.nrows - s.cnt) / s.nrows AS missing_pct,
         s.mean, s.median, m.mode, s.std, s.var, s.mn AS "min", s.mx AS "max", s.q1, s.q3,
         s.q3 - s.q1 AS iqr, s.skew, s.kurtosis,
         CASE WHEN s.mean = 0 THEN 0.0 ELSE s.std / (abs(s.mean) + 1e-6) END AS cv,
         (SELECT count(*) FROM {table} t WHERE CAST(t.{name} AS DOUBLE) < s.q1 - 1.5 * (s.q3 - s.q1)
             OR CAST(t.{name} AS DOUBLE) > s.q3 + 1.5 * (s.q3 - s.q1)) AS outliers,
         s.q1 - 1.5 * (s.q3 - s.q1) AS lower_fence, s.q3 + 1.5 * (s.q3 - s.q1) AS upper_fence
  FROM (SELECT count(*) AS nrows, count({x}) AS cnt, avg({x}) AS mean,
               quantile_cont({x}, 0.5) AS median, stddev_samp({x}) AS std, var_samp({x}) AS var,
               min({x}) AS mn, max({x}) AS mx, quantile_cont({x}, 0.25) AS q1,
               quantile_cont({x}, 0.75) AS q3, skewness({x}) AS skew, kurtosis({x}) AS kurtosis
        FROM {table}) s,
       (SELECT {x} AS mode FROM {table} WHERE {name} IS NOT NULL
        GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) m""")
    return oracle_finish("\nUNION ALL\n".join(parts), SUMMARY_DOUBLES)


# ---------------------------------------------------------------- U1 / U2 / U5

@register("univariate_numeric", numeric_summary_sql("lineitem", [(c, i) for i, c in enumerate(LINEITEM_NUM)]))
def q_univariate_numeric(spark, sf):
    return finish(P.numeric_summary(load(spark, sf, "lineitem"), LINEITEM_NUM))


@register("outlier_profile", FX.with_views(numeric_summary_sql("outlier_orders", [("o_totalprice", 0)]),
                                           "outlier_orders"))
def q_outlier_profile(spark, sf):
    return finish(P.numeric_summary(FX.outlier_orders(spark, sf), ["o_totalprice"]))


# ---------------------------------------------------------------- U3

def _cat_summary_sql(table, cols):
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"""
  SELECT '{c}' AS "column", CAST({i} AS BIGINT) AS ordinal,
         (SELECT count(DISTINCT {c}) FROM {table}) AS "unique",
         (SELECT count(*) - count({c}) FROM {table}) AS missing,
         (SELECT 100.0 * (count(*) - count({c})) / count(*) FROM {table}) AS missing_pct,
         (SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_category,
         (SELECT count(DISTINCT {c}) * 1.0 / count(*) FROM {table}) AS cardinality_ratio""")
    return oracle_finish("\nUNION ALL\n".join(parts), ["missing_pct", "cardinality_ratio"])


ORDERS_CAT = ["o_orderstatus", "o_orderpriority"]
CUSTOMER_CAT = ["c_name", "c_mktsegment"]


@register("univariate_categorical", _cat_summary_sql("customer", CUSTOMER_CAT))
def q_univariate_categorical(spark, sf):
    return finish(P.categorical_summary(load(spark, sf, "customer"), CUSTOMER_CAT))


def _top_values_sql(table, cols, k):
    parts = [f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {table} "
             f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols]
    return f"""
SELECT "column", CAST(rnk AS BIGINT) AS "rank", value, n FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rnk
  FROM ({' UNION ALL '.join(parts)}) v) r
WHERE rnk <= {k}"""


PART_CAT = ["p_name", "p_brand", "p_type"]


@register("top_values", _top_values_sql("part", PART_CAT, 10))
def q_top_values(spark, sf):
    return finish(P.top_values(load(spark, sf, "part"), PART_CAT, k=10))


# ---------------------------------------------------------------- U4

def _histogram_sql(table, cols, max_bins=30):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""
  SELECT '{c}' AS "column", b.bin, s.mn + (b.bin - 1) * ((s.mx - s.mn) / s.nb) AS lo,
         s.mn + b.bin * ((s.mx - s.mn) / s.nb) AS hi, coalesce(h.n, 0) AS n,
         100.0 * coalesce(h.n, 0) / s.total AS pct
  FROM (SELECT min({x}) AS mn, max({x}) AS mx, count({x}) AS total,
               CAST(least({max_bins}, floor(sqrt(count({x})))) AS INTEGER) AS nb FROM {table}) s
  CROSS JOIN LATERAL (SELECT CAST(unnest(range(1, s.nb + 1)) AS INTEGER) AS bin) b
  LEFT JOIN (
     SELECT CAST(least(floor(({x} - s2.mn) / (s2.mx - s2.mn) * s2.nb) + 1, s2.nb) AS INTEGER) AS bin,
            count(*) AS n
     FROM {table}, (SELECT min({x}) AS mn, max({x}) AS mx,
                    CAST(least({max_bins}, floor(sqrt(count({x})))) AS INTEGER) AS nb FROM {table}) s2
     WHERE {x} IS NOT NULL GROUP BY 1) h ON h.bin = b.bin""")
    return oracle_finish("\nUNION ALL\n".join(parts), ["lo", "hi", "pct"], ["bin"])


HIST_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("histogram", _histogram_sql("lineitem", HIST_COLS))
def q_histogram(spark, sf):
    return finish(P.histogram(load(spark, sf, "lineitem"), HIST_COLS))


# ---------------------------------------------------------------- U6

def _pie_sql(table, cols, lo=2, hi=10):
    parts = [f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {table} "
             f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols]
    return oracle_finish(f"""
SELECT "column", substr(value, 1, 50) AS name, n AS value, CAST(total AS BIGINT) AS total,
       100.0 * n / total AS pct
FROM (SELECT *, count(*) OVER (PARTITION BY "column") AS d, sum(n) OVER (PARTITION BY "column") AS total
      FROM ({' UNION ALL '.join(parts)}) v) w
WHERE d BETWEEN {lo} AND {hi}""", ["pct"])


@register("pie", _pie_sql("orders", ORDERS_CAT))
def q_pie(spark, sf):
    return finish(P.pie(load(spark, sf, "orders"), ORDERS_CAT))


# ---------------------------------------------------------------- P9 / P10 / P22 on cleaned dirty data

DIRTY_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _clean_sql_expr(c):
    """P1 + P2 in DuckDB: blank (incl. NBSP) or a null token -> NULL."""
    return (f"CASE WHEN regexp_matches(CAST({c} AS VARCHAR), '^[\\s\\x{{00A0}}]*$') "
            f"OR CAST({c} AS VARCHAR) IN ('nan','NaN','None','null','NULL','NA') THEN NULL ELSE {c} END")


def _missing_sql():
    seg = _clean_sql_expr("c_mktsegment")
    parts = []
    for i, c in enumerate(DIRTY_COLS):
        e = seg if c == "c_mktsegment" else c
        parts.append(f"""
  SELECT '{c}' AS "column", CAST({i} AS BIGINT) AS ordinal, count(*) - count({e}) AS missing,
         100.0 * (count(*) - count({e})) / count(*) AS pct,
         CASE WHEN count({e}) = 0 THEN 'empty' WHEN count(*) > count({e}) THEN 'partial'
              ELSE 'complete' END AS status
  FROM dirty_customer""")
    return FX.with_views(oracle_finish("\nUNION ALL\n".join(parts), ["pct"]), "dirty_customer")


@register("missing_profile", _missing_sql())
def q_missing_profile(spark, sf):
    from quarry.operators.clean import null_tokens_to_null
    df = null_tokens_to_null(FX.dirty_customer(spark, sf))
    return finish(P.missing_profile(df))


def _quality_sql():
    return FX.with_views(_quality_body(), "dirty_customer")


def _quality_body():
    seg = _clean_sql_expr("c_mktsegment")
    miss = " + ".join(f"(count(*) - count({seg if c == 'c_mktsegment' else c}))" for c in DIRTY_COLS)
    n = len(DIRTY_COLS)
    return oracle_finish(f"""
SELECT nrows AS "rows", CAST({n} AS BIGINT) AS "columns", total_missing,
       100.0 * total_missing / (nrows * {n}) AS missing_pct,
       100.0 * (1 - total_missing / (nrows * {n})) AS completeness,
       CASE WHEN 100.0 * (1 - total_missing / (nrows * {n})) >= 95 THEN 'excellente'
            WHEN 100.0 * (1 - total_missing / (nrows * {n})) >= 85 THEN 'bonne'
            WHEN 100.0 * (1 - total_missing / (nrows * {n})) >= 70 THEN 'acceptable'
            WHEN 100.0 * (1 - total_missing / (nrows * {n})) >= 50 THEN 'moyenne'
            ELSE 'faible' END AS quality
FROM (SELECT count(*) AS nrows, CAST({miss} AS BIGINT) AS total_missing FROM dirty_customer) t""",
        ["missing_pct", "completeness"])


@register("data_quality", _quality_sql())
def q_data_quality(spark, sf):
    from quarry.operators.clean import null_tokens_to_null
    return finish(P.data_quality(null_tokens_to_null(FX.dirty_customer(spark, sf))))


# ---------------------------------------------------------------- P11 / P13 / P16 column profile

ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"]


def _column_profile_sql():
    kinds = {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical",
             "o_totalprice": "numeric", "o_orderdate": "temporal", "o_orderpriority": "categorical"}
    parts = []
    for i, c in enumerate(ORDERS_COLS):
        num = kinds[c] == "numeric"
        x = f"CAST({c} AS DOUBLE)"
        stat = (lambda e: e) if num else (lambda e: "CAST(NULL AS DOUBLE)")
        parts.append(f"""
  SELECT 'raw' AS stage, '{c}' AS "column", CAST({i} AS BIGINT) AS ordinal, '{kinds[c]}' AS kind,
         '{P.theme_of(c)}' AS theme, count({c}) AS n, count(*) - count({c}) AS n_null,
         count(DISTINCT {c}) AS n_distinct,
         {stat(f"avg({x})")} AS mean, {stat(f"stddev_samp({x})")} AS sd, {stat(f"var_samp({x})")} AS var,
         {stat(f"min({x})")} AS "min", {stat(f"max({x})")} AS "max",
         {stat(f"quantile_cont({x}, 0.25)")} AS q1, {stat(f"quantile_cont({x}, 0.5)")} AS median,
         {stat(f"quantile_cont({x}, 0.75)")} AS q3, {stat(f"skewness({x})")} AS skew,
         {stat(f"kurtosis({x})")} AS kurt
  FROM orders""")
    return oracle_finish("\nUNION ALL\n".join(parts),
                         ["mean", "sd", "var", '"min"', '"max"', "q1", "median", "q3", "skew", "kurt"])


@register("column_profile", _column_profile_sql())
def q_column_profile(spark, sf):
    return finish(P.column_profile(load(spark, sf, "orders").select(*ORDERS_COLS)))


# ---------------------------------------------------------------- P14

def _samples_sql():
    cols = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    parts = [f"SELECT DISTINCT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM part WHERE {c} IS NOT NULL"
             for c in cols]
    return f"""
SELECT "column", CAST(rnk AS BIGINT) AS "rank", substr(value, 1, 50) AS sample FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) AS rnk
  FROM ({' UNION ALL '.join(parts)}) v) r WHERE rnk <= 3"""


@register("category_samples", _samples_sql())
def q_category_samples(spark, sf):
    return finish(P.category_samples(load(spark, sf, "part")))


# ---------------------------------------------------------------- S7 preview

@register("preview", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 500""")
def q_preview(spark, sf):
    from quarry.sources.preview import preview
    return preview(load(spark, sf, "orders"), key="o_orderkey", n=500)


# ---------------------------------------------------------------- U7 / U8 / P3


@register("scatter_sample", oracle_finish("""
WITH long AS (
  SELECT 'o_custkey' AS var, o_orderkey AS key, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM orders
  UNION ALL SELECT 'o_orderkey', o_orderkey, CAST(o_orderkey AS DOUBLE), o_totalprice FROM orders),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY var ORDER BY md5(var || '|' || key), key) AS BIGINT) AS "rank" FROM long
      WHERE x IS NOT NULL AND y IS NOT NULL QUALIFY "rank" <= 500)
SELECT var, key, x, y, "rank", corr(x, y) OVER (PARTITION BY var) AS sample_r FROM s""", ["x", "y", "sample_r"]))
def q_scatter_sample(spark, sf):
    """The 500 complete pairs per variable of least md5, and the sample's r (the limit is the feature)."""
    return finish(P.scatter_sample(load(spark, sf, "orders"), "o_totalprice", ["o_custkey", "o_orderkey"], "o_orderkey"))


def _date_detection_sql():
    parsed = " OR ".join(f"try_strptime({{c}}, '{f}') IS NOT NULL"
                         for f in ("%Y-%m-%d", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%d-%m-%Y", "%m/%d/%Y"))
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN NULL WHEN {parsed.format(c=c)} THEN 1.0 ELSE 0.0 END) AS share "
        f"FROM text_orders" for c in ("priority_text", "order_date"))
    return FX.with_views(oracle_finish(f"""
SELECT "column", 'categorical' AS kind, coalesce(share, 0) AS parsed_share, coalesce(share, 0) > 0.8 AS is_date FROM ({rows}) t
UNION ALL SELECT 'o_orderdate', 'temporal', 1.0, TRUE""", ["parsed_share"]), "text_orders")


@register("date_detection", _date_detection_sql())
def q_date_detection(spark, sf):
    """U8: typed date columns plus string columns whose values mostly parse."""
    return finish(P.date_columns(FX.text_orders(spark, sf).join(
        load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")))


@register("drop_empty", FX.with_views("""
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment, ref_id, note, opt, konst
FROM sparse_customer""", "sparse_customer"))
def q_drop_empty(spark, sf):
    from quarry.operators.clean import drop_empty_columns
    out, _ = drop_empty_columns(FX.sparse_customer(spark, sf))
    return finish(out)
