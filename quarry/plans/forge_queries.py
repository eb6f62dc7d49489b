"""Registered preparation (F1-F13) and feature-forge (G1, G3-G14) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import forge as G
from quarry.operators import prepare as PR
from quarry.operators.clean import null_tokens_to_null
from quarry.plans import fixtures as FX
from quarry.plans.common import finish, oracle_finish, register
from quarry.sources.tables import load

# ---------------------------------------------------------------- F1


@register("merge_flags", FX.with_views("""
SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_retailprice,
       CAST((q_a_b_c_x = 'Eny')::INT + (q_a_b_c_y = 'Eny')::INT + (q_a_b_c_z = 'Eny')::INT AS BIGINT) AS q_a_b_c_COUNT
FROM flags_part""", "flags_part"))
def q_merge_flags(spark, sf):
    df, _ = PR.merge_flags(FX.flags_part(spark, sf))
    return finish(df)


# ---------------------------------------------------------------- F2

F2_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
           "net", "neg", "half", "const"]


def _f2_sql():
    parts = []
    for j, b in enumerate(F2_COLS):
        if j == 0:
            parts.append(f"SELECT '{b}' AS \"column\", CAST(0 AS BIGINT) AS ordinal, CAST(NULL AS DOUBLE) AS max_abs_r")
            continue
        rs = ", ".join(
            f"CASE WHEN isnan(corr(coalesce({a}, 0), coalesce({b}, 0))) THEN NULL "
            f"ELSE abs(corr(coalesce({a}, 0), coalesce({b}, 0))) END" for a in F2_COLS[:j])
        parts.append(f"SELECT '{b}', CAST({j} AS BIGINT), "
                     f"(SELECT max(x) FROM (SELECT unnest([{rs}]) AS x) u) FROM corr_lineitem")
    inner = ("SELECT *, coalesce(max_abs_r >= 0.99, false) AS dropped FROM ("
             + " UNION ALL ".join(parts) + ") t")
    return FX.with_views(oracle_finish(inner, ["max_abs_r"]), "corr_lineitem")


@register("drop_correlated", _f2_sql())
def q_drop_correlated(spark, sf):
    """F2 decision table: max |r| against earlier columns (nulls as 0) and the drop flag."""
    df = FX.corr_lineitem(spark, sf).select(*F2_COLS)
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in F2_COLS])
    from quarry.operators.relate import pearson_pairs
    r = {(a, b): v for a, b, _, v in pearson_pairs(filled, F2_COLS)}
    _, dropped = PR.drop_correlated(df)
    rows = []
    for j, b in enumerate(F2_COLS):
        vals = [abs(r[(F2_COLS[i], b)]) for i in range(j) if r.get((F2_COLS[i], b)) is not None]
        rows.append((b, j, max(vals) if vals else None, b in dropped))
    return finish(spark.createDataFrame(rows, "column string, ordinal long, max_abs_r double, dropped boolean"))


# ---------------------------------------------------------------- F3 / F4


@register("age_sanity", FX.with_views("""
SELECT c_custkey, CASE WHEN age BETWEEN 0 AND 100 THEN age END AS age FROM age_customer""", "age_customer"))
def q_age_sanity(spark, sf):
    return finish(PR.age_sanity(FX.age_customer(spark, sf)).select("c_custkey", "age"))


def _winsor_sql():
    cols = ["o_orderkey", "o_custkey", "o_totalprice"]
    stats = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in cols)
    sel = ", ".join(
        f"CASE WHEN {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}) THEN q3_{c} + 1.5 * (q3_{c} - q1_{c}) "
        f"WHEN {c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) THEN q1_{c} - 1.5 * (q3_{c} - q1_{c}) "
        f"ELSE CAST({c} AS DOUBLE) END AS {c}" for c in cols)
    return FX.with_views(oracle_finish(
        f"SELECT {sel}, o_orderstatus, o_orderpriority FROM outlier_orders, (SELECT {stats} FROM outlier_orders) s",
        cols), "outlier_orders")


@register("winsorize", _winsor_sql())
def q_winsorize(spark, sf):
    df, _ = PR.winsorize(FX.outlier_orders(spark, sf))
    return finish(df)


# ---------------------------------------------------------------- F5 / F6 / F7


@register("text_dates", FX.with_views("""
SELECT o_orderkey, regexp_replace(lower(regexp_replace(priority_text, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')),
                                  '[\\s\\x{00A0}]+', ' ', 'g') AS priority_text,
       strftime(try_strptime(order_date, '%d/%m/%Y'), '%Y-%m-%d') AS order_date
FROM text_orders""", "text_orders"))
def q_text_dates(spark, sf):
    df = PR.harmonize_dates(PR.normalize_text(FX.text_orders(spark, sf), ["priority_text"]))
    return df.select("o_orderkey", "priority_text", F.date_format("order_date", "yyyy-MM-dd").alias("order_date"))


@register("impute", FX.with_views(oracle_finish("""
SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey,
       coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM dirty_customer)) AS c_acctbal,
       coalesce(CASE WHEN regexp_matches(c_mktsegment, '^[\\s\\x{00A0}]*$')
                       OR c_mktsegment IN ('nan','NaN','None','null','NULL','NA') THEN NULL ELSE c_mktsegment END,
                'non_defini') AS c_mktsegment
FROM dirty_customer""", ["c_acctbal"]), "dirty_customer"))
def q_impute(spark, sf):
    df = null_tokens_to_null(FX.dirty_customer(spark, sf)).select("c_custkey", "c_nationkey", "c_acctbal",
                                                                   "c_mktsegment")
    out, _ = PR.impute(df)
    return finish(out)


# ---------------------------------------------------------------- F8 / F9 / F10 / F12


@register("label_encode", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS o_orderpriority
FROM orders""")
def q_label_encode(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return PR.label_encode(o, "o_orderpriority", bounded=False)


@register("one_hot", """
SELECT o_orderkey, coalesce(o_orderstatus = 'F', false) AS o_orderstatus_F,
       coalesce(o_orderstatus = 'O', false) AS o_orderstatus_O, coalesce(o_orderstatus = 'P', false) AS o_orderstatus_P
FROM orders""")
def q_one_hot(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    vals = sorted(r[0] for r in o.select("o_orderstatus").distinct().collect())
    return PR.one_hot(o, "o_orderstatus", vals)


MM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("minmax_scale", oracle_finish(
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, "
    + ", ".join(f"(CAST({c} AS DOUBLE) - (SELECT min({c}) FROM lineitem)) / "
                f"((SELECT max({c}) FROM lineitem) - (SELECT min({c}) FROM lineitem)) AS {c}" for c in MM_COLS)
    + " FROM lineitem", MM_COLS))
def q_minmax_scale(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *MM_COLS)
    return finish(PR.minmax_scale(li, MM_COLS))


@register("prepare_chain")
def q_prepare_chain(spark, sf):
    """F13 over part with select-multiple flags; checked on rows (data-dependent schema)."""
    p = load(spark, sf, "part")
    f = FX.flags_part(spark, sf).select("p_partkey", "q_a_b_c_x", "q_a_b_c_y", "q_a_b_c_z")
    df = p.join(f, "p_partkey")
    out, _ = PR.process_features(df, target="p_retailprice")
    return out


# ---------------------------------------------------------------- G1


@register("temporal_features", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_annee,
       CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_mois,
       CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_jour_semaine,
       CAST(CASE WHEN isodow(o_orderdate) - 1 >= 5 THEN 1 ELSE 0 END AS INTEGER) AS o_orderdate_is_weekend,
       CAST(floor((epoch(TIMESTAMP '2025-01-01') - epoch(o_orderdate)) / 86400) AS BIGINT) AS o_orderdate_anciennete_jours
FROM orders""")
def q_temporal_features(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    out, _ = G.temporal_features(o, as_of="2025-01-01")
    return out.drop("o_orderdate")


# ---------------------------------------------------------------- G3 / G4


def _interaction_sql():
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    sel = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            if len(sel) >= 10:
                break
            ba, bb = a.replace("_", "")[:10], b.replace("_", "")[:10]
            sel.append(f"CASE WHEN (SELECT avg(CASE WHEN coalesce({b} <> 0, true) THEN 1.0 ELSE 0.0 END) FROM lineitem) > 0.5 "
                       f"THEN {a} / nullif({b}, 0) END AS ratio_{ba}_vs_{bb}")
            sel.append(f"{a} - {b} AS diff_{ba}_vs_{bb}")
    names = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            ba, bb = a.replace("_", "")[:10], b.replace("_", "")[:10]
            names += [f"ratio_{ba}_vs_{bb}", f"diff_{ba}_vs_{bb}"]
    return oracle_finish(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {', '.join(sel)} FROM lineitem",
                         names[:10])


@register("interaction_features", _interaction_sql())
def q_interaction_features(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    out, _ = G.interaction_features(li, cols, max_interactions=10)
    return finish(out.drop(*cols))


@register("group_mean_features", oracle_finish("""
SELECT o_orderkey, o_totalprice,
       avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS ototalpr_mean_by_oorderst,
       o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS ototalpr_ecart_oorderst,
       avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS ototalpr_mean_by_oorderpr,
       o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS ototalpr_ecart_oorderpr
FROM orders""", ["o_totalprice", "ototalpr_mean_by_oorderst", "ototalpr_ecart_oorderst",
                 "ototalpr_mean_by_oorderpr", "ototalpr_ecart_oorderpr"], digits=8))
def q_group_mean_features(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    out, _ = G.group_mean_features(o, ["o_totalprice"], ["o_orderstatus", "o_orderpriority"])
    # deviations from the group mean cancel ~4 digits: compare at 8 significant digits
    return finish(out.drop("o_orderstatus", "o_orderpriority"), digits=8)


# ---------------------------------------------------------------- G5 / G6 / G7

PART_CATS = ["p_name", "p_brand", "p_type"]


@register("encoding_plan", """
SELECT "column", ordinal, n_distinct,
       CASE WHEN n_distinct > 50 THEN 'skipped' WHEN n_distinct <= 8 THEN 'one_hot' ELSE 'label' END AS action
FROM (SELECT 'p_name' AS "column", CAST(0 AS BIGINT) AS ordinal, count(DISTINCT p_name) AS n_distinct FROM part
      UNION ALL SELECT 'p_brand', 1, count(DISTINCT p_brand) FROM part
      UNION ALL SELECT 'p_type', 2, count(DISTINCT p_type) FROM part) t""")
def q_encoding_plan(spark, sf):
    return G.encoding_plan(load(spark, sf, "part"), PART_CATS)


def _encode_sql():
    types = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    onehot = ", ".join(f"CAST(coalesce(p_type = '{t}', false) AS INTEGER) AS p_type_{t}" for t in types)
    return f"""
SELECT p_partkey, p_name, {onehot},
       CAST(coalesce(dense_rank() OVER (ORDER BY CASE WHEN p_brand IS NULL THEN NULL ELSE p_brand END) - 1, -1) AS BIGINT)
         AS p_brand_encoded
FROM part"""


@register("encode_categoricals", _encode_sql())
def q_encode_categoricals(spark, sf):
    """G5 + G6 following the G7 plan on part: p_type one-hot (ints), p_brand label codes,
    p_name skipped (> 50 values, kept as is). The oracle fixes the six type values."""
    out, _ = G.encode_categoricals(load(spark, sf, "part").select("p_partkey", *PART_CATS), PART_CATS)
    return out


# ---------------------------------------------------------------- G8 / G9

SCALE_COLS = ["event_id", "user_id", "value", "value3"]


def _scaling_inner():
    parts = []
    for i, c in enumerate(SCALE_COLS):
        parts.append(f"""
  SELECT '{c}' AS "column", CAST({i} AS BIGINT) AS k, count({c}) AS n, avg({c}) AS mean,
         stddev_pop({c}) AS sd_pop, stddev_samp({c}) AS sd, skewness({c}) AS skew, min({c}) AS mn, max({c}) AS mx,
         quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3,
         (SELECT CASE WHEN min(s.q3) <= min(s.q1) THEN 0.0 ELSE avg(CASE WHEN {c} < s.q1 - 1.5 * (s.q3 - s.q1) OR {c} > s.q3 + 1.5 * (s.q3 - s.q1) THEN 1.0 ELSE 0.0 END) END
          FROM skew_events, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM skew_events) s
          WHERE {c} IS NOT NULL) AS share
  FROM skew_events""")
    return f"""
SELECT "column", CASE WHEN share > 0.1 THEN 'robust' WHEN (CASE WHEN n > 20 THEN abs(skew) ELSE 0 END) < 1
                      THEN 'standard' ELSE 'minmax' END AS method,
       share AS outlier_share, CASE WHEN n > 20 THEN abs(skew) ELSE 0 END AS abs_skew, mean, sd_pop,
       mn AS "min", mx AS "max", median, q1, q3
FROM ({' UNION ALL '.join(parts)}) t
WHERE n >= 20 AND NOT (mn >= 0 AND mx <= 1) AND NOT (abs(mean) < 0.5 AND abs(sd - 1) < 0.5)"""


def _scaling_sql():
    return FX.with_views(oracle_finish(_scaling_inner(), ["outlier_share", "abs_skew", "mean", "sd_pop", '"min"', '"max"',
                                               "median", "q1", "q3"]), "skew_events")


@register("scaling_plan", _scaling_sql())
def q_scaling_plan(spark, sf):
    return finish(G.scaling_plan(FX.skew_events(spark, sf), SCALE_COLS))


def _scaled_sql():
    """The scaled values of every planned column in long form: event_id, column, scaled value."""
    parts = []
    for c in SCALE_COLS:
        parts.append(f"""
  SELECT e.event_id, '{c}' AS "column",
         CASE p.method WHEN 'standard' THEN (coalesce({c}, p.median) - p.mean) / p.sd_pop
                       WHEN 'minmax' THEN (coalesce({c}, p.median) - p."min") / (p."max" - p."min")
                       ELSE (coalesce({c}, p.median) - p.median) / (p.q3 - p.q1) END AS scaled
  FROM skew_events e JOIN plan p ON p."column" = '{c}'""")
    return FX.with_views(oracle_finish(f"WITH plan AS ({_scaling_inner()}) " + " UNION ALL ".join(parts), ["scaled"], digits=9), "skew_events")


@register("scaled_values", _scaled_sql())
def q_scaled_values(spark, sf):
    """G8 transform: every scaled column's values in long form."""
    df = FX.skew_events(spark, sf)
    out = G.apply_scaling(df, G.scaling_plan(df, SCALE_COLS))
    made = [c for c in out.columns if c.endswith("_scaled")]
    long = out.select("event_id", F.explode(F.array(*[F.struct(F.lit(c[:-7]).alias("column"), F.col(c).alias("scaled")) for c in made])).alias("s"))
    return finish(long.select("event_id", "s.column", "s.scaled"), 9)


@register("log_transform", FX.with_views(oracle_finish("""
SELECT 'value3' AS "column", skewness(value3) AS original_skew, skewness(ln(1 + value3)) AS new_skew
FROM skew_events HAVING count(value3) >= 30 AND skewness(value3) > 2 AND min(value3) > 0
UNION ALL
SELECT 'value', skewness(value), skewness(ln(1 + value)) FROM skew_events
HAVING count(value) >= 30 AND skewness(value) > 2 AND min(value) > 0""", ["original_skew", "new_skew"]),
    "skew_events"))
def q_log_transform(spark, sf):
    _, rep = G.log_transforms(FX.skew_events(spark, sf), ["value", "value3"])
    return finish(rep)


# ---------------------------------------------------------------- G10 - G14


@register("pca_variance")
def q_pca_variance(spark, sf):
    """G10 on the lineitem numerics: explained-variance table (Spark ML; rows-only)."""
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]
    _, table = G.pca_features(load(spark, sf, "lineitem"), cols)
    return table


def _selection_sql():
    """Low variance first; of what remains (more than five columns) the columns that correlate above 0.95 with
    any earlier remaining one, the first third of the remaining at most."""
    var = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({i} AS BIGINT) AS ordinal, "
                             f"var_pop(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM corr_lineitem))) AS var_pop FROM corr_lineitem"
                             for i, c in enumerate(F2_COLS))
    med = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM corr_lineitem)) AS {c}" for c in F2_COLS)
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {i} AS i, {j} AS j, abs(corr({a}, {b})) AS r FROM filled"
                               for j, b in enumerate(F2_COLS) for i, a in enumerate(F2_COLS[:j]))
    return FX.with_views(oracle_finish(f"""
WITH filled AS (SELECT {med} FROM corr_lineitem), v AS ({var}),
rest AS (SELECT * FROM v WHERE var_pop > 0.01), pr AS ({pairs}),
found AS (SELECT DISTINCT rb.ordinal, rb."column" FROM pr JOIN rest ra ON ra."column" = pr.a JOIN rest rb ON rb."column" = pr.b
          WHERE NOT isnan(r) AND r > 0.95),
redundant AS (SELECT "column" FROM found WHERE (SELECT count(*) FROM rest) > 5
              QUALIFY row_number() OVER (ORDER BY ordinal) <= floor((SELECT count(*) FROM rest) / 3))
SELECT v."column", ordinal, var_pop, CASE WHEN var_pop <= 0.01 THEN 'low_variance'
       WHEN v."column" IN (SELECT "column" FROM redundant) THEN 'redundant' ELSE 'kept' END AS reason FROM v""", ["var_pop"]), "corr_lineitem")


@register("feature_selection", _selection_sql())
def q_feature_selection(spark, sf):
    """G11-G13 reasons table."""
    return finish(G.selection_report(FX.corr_lineitem(spark, sf), F2_COLS))


@register("forge")
def q_forge(spark, sf):
    """G14 end to end on orders (data-dependent schema; rows-only)."""
    out, _ = G.forge_features(load(spark, sf, "orders"), as_of="2025-01-01")
    return out
