"""Registered cleaning (P1-P8, P12), selection (P15, P17-P21, K1, G2) and geography (A1-A8) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import clean as C
from quarry.operators import geo as G
from quarry.operators import select as S
from quarry.operators.profile import column_profile
from quarry.plans import fixtures as FX
from quarry.plans.common import finish, oracle_finish, register
from quarry.sources.tables import load

# ---------------------------------------------------------------- P1 / P2


@register("clean_nulls", FX.with_views("""
SELECT c_custkey, CASE WHEN regexp_matches(c_name, '^[\\s\\x{00A0}]*$') OR c_name IN ('nan','NaN','None','null','NULL','NA') THEN NULL ELSE c_name END AS c_name,
       CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
       CASE WHEN regexp_matches(c_mktsegment, '^[\\s\\x{00A0}]*$') OR c_mktsegment IN ('nan','NaN','None','null','NULL','NA') THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM dirty_customer""", "dirty_customer"))
def q_clean_nulls(spark, sf):
    return finish(C.null_tokens_to_null(FX.dirty_customer(spark, sf)))


# ---------------------------------------------------------------- P4 / P5

SPARSE_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "ref_id", "note",
               "opt", "konst", "empty_col"]


def _sparse_sql():
    parts = []
    for i, c in enumerate(SPARSE_COLS):
        s = f"CAST({c} AS VARCHAR)"
        v = (f"CASE WHEN regexp_matches({s}, '^[\\s\\x{{00A0}}]*$') OR {s} IN ('nan','NaN','None','null') "
             f"THEN NULL ELSE {s} END")
        kw_case = " ".join(
            f"WHEN regexp_matches(lower('{c}'), '(^|[^a-z0-9]){k}($|[^a-z0-9])') THEN '{k}'"
            for k in C.CRITICAL_KEYWORDS)
        flags = ", ".join(f"'{f}'" for f in C.FLAG_VALUES)
        parts.append(f"""
  SELECT '{c}' AS "column", CAST({i} AS BIGINT) AS ordinal, missing_rate,
         CASE WHEN nn > 0 AND lo = hi THEN lo END AS single_value,
         CASE WHEN missing_rate = 1.0 THEN 'drop_empty' WHEN missing_rate < 0.9 THEN 'keep'
              WHEN kw IS NOT NULL THEN 'keep'
              WHEN nn > 0 AND lo = hi THEN CASE WHEN lo IN ({flags}) THEN 'keep' ELSE 'drop_sparse' END
              ELSE 'drop_sparse' END AS action,
         CASE WHEN missing_rate = 1.0 THEN 'empty' WHEN missing_rate < 0.9 THEN 'enough data'
              WHEN kw IS NOT NULL THEN 'critical keyword ''' || kw || ''''
              WHEN nn > 0 AND lo = hi THEN CASE WHEN lo IN ({flags}) THEN 'binary flag' ELSE 'constant value' END
              ELSE 'too sparse' END AS reason
  FROM (SELECT 1.0 - count({v}) / count(*) AS missing_rate, count({v}) AS nn, min({v}) AS lo,
               max({v}) AS hi, CASE {kw_case} END AS kw FROM sparse_customer) t""")
    return FX.with_views(oracle_finish("\nUNION ALL\n".join(parts), ["missing_rate"]), "sparse_customer")


@register("sparse_decisions", _sparse_sql())
def q_sparse_decisions(spark, sf):
    return finish(C.sparse_decisions(FX.sparse_customer(spark, sf)))


@register("smart_clean", FX.with_views("""
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment, ref_id, opt
FROM sparse_customer""", "sparse_customer"))
def q_smart_clean(spark, sf):
    df, _ = C.smart_clean(FX.sparse_customer(spark, sf), aggressive=True)
    return finish(df)


# ---------------------------------------------------------------- P6 / P7 / P8 / P12


@register("dedupe", FX.with_views("""
SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM dup_orders""", "dup_orders"))
def q_dedupe(spark, sf):
    df, _ = C.dedupe(FX.dup_orders(spark, sf))
    return finish(df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))


MESSY = {"c_custkey": "Clé Client", "c_name": "Nom  du Client", "c_nationkey": "Nation#",
         "c_acctbal": "Solde (€)", "c_mktsegment": "Segment-Marché"}


@register("normalize_headers", """
SELECT c_custkey AS cle_client, c_name AS nom_du_client, CAST(c_nationkey AS BIGINT) AS nation,
       c_acctbal AS solde, c_mktsegment AS segment_marche FROM customer""")
def q_normalize_headers(spark, sf):
    c = load(spark, sf, "customer").select(*[F.col(k).alias(v) for k, v in MESSY.items()])
    return finish(C.normalize_headers(c))


ORDERS_ALL = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _types_sql():
    parts = []
    for i, c in enumerate(ORDERS_ALL):
        s = f"trim(CAST({c} AS VARCHAR))"
        parts.append(f"""
  SELECT '{c}' AS "column", CAST({i} AS BIGINT) AS ordinal,
         CASE WHEN count({s}) = 0 THEN 'string'
              WHEN count_if(regexp_matches({s}, '{C.INT_PATTERN}')) = count({s}) THEN 'bigint'
              WHEN count_if(regexp_matches({s}, '{C.DOUBLE_PATTERN}')) = count({s}) THEN 'double'
              WHEN count_if(regexp_matches({s}, '{C.BOOL_PATTERN}')) = count({s}) THEN 'boolean'
              WHEN count_if(regexp_matches({s}, '{C.TS_PATTERN}')) = count({s}) THEN 'timestamp'
              ELSE 'string' END AS inferred
  FROM orders""")
    return "\nUNION ALL\n".join(parts)


@register("type_inference", _types_sql())
def q_type_inference(spark, sf):
    o = load(spark, sf, "orders")
    text = o.select(*[F.col(c).cast("string").alias(c) for c in ORDERS_ALL])
    _, plan = C.infer_types(text)
    return finish(plan)


def _nonfinite_events(spark, sf):
    e = load(spark, sf, "events")
    v = (F.when(F.col("event_id") % 17 == 0, F.lit(float("nan")))
         .when(F.col("event_id") % 19 == 0, F.lit(float("inf")))
         .when(F.col("event_id") % 23 == 0, F.lit(float("-inf"))).otherwise(F.col("value")))
    return e.select("event_id", "event_type", v.alias("value"))


@register("nonfinite_cleanup", oracle_finish("""
SELECT event_type, count(*) AS n, count(*) - count(value) AS n_null, avg(value) AS avg_value
FROM (SELECT event_type, CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0
                              THEN NULL ELSE value END AS value FROM events) t
GROUP BY event_type""", ["avg_value"]))
def q_nonfinite_cleanup(spark, sf):
    clean = C.nonfinite_to_null(_nonfinite_events(spark, sf))
    return finish(clean.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("n_null"),
        F.avg("value").alias("avg_value")))


# ---------------------------------------------------------------- P15


def _geo_table(spark, sf):
    r, n, c = load(spark, sf, "region"), load(spark, sf, "nation"), load(spark, sf, "customer")
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("r_name").alias("region"), F.col("n_name").alias("district"),
                    F.col("c_mktsegment").alias("commune"), F.col("c_name").alias("village"),
                    F.col("c_acctbal").alias("gps_coord")))


@register("geo_extract", """
WITH g AS (SELECT r_name AS region, n_name AS district, c_mktsegment AS commune, c_name AS village
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
v AS (SELECT DISTINCT 'region' AS level, trim(region) AS value FROM g WHERE region <> ''
      UNION SELECT 'region', trim(district) FROM g WHERE district <> ''
      UNION SELECT 'commune', trim(commune) FROM g WHERE commune <> ''
      UNION SELECT 'village', trim(village) FROM g WHERE village <> '')
SELECT level, CAST("rank" AS BIGINT) AS "rank", value, true AS has_gps FROM (
  SELECT *, row_number() OVER (PARTITION BY level ORDER BY value) AS "rank" FROM v) t
WHERE "rank" <= CASE level WHEN 'region' THEN 3 ELSE 5 END""")
def q_geo_extract(spark, sf):
    return finish(G.extract_locations(_geo_table(spark, sf)))


# ---------------------------------------------------------------- P17 / P21 / K1 / G2 over a SQL profile

LI_KINDS = [("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"),
            ("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"),
            ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "categorical"),
            ("l_linestatus", "categorical"), ("l_shipdate", "temporal")]


def profile_sql(table, kinds):
    parts = []
    for i, (c, k) in enumerate(kinds):
        x = f"CAST({c} AS DOUBLE)"
        num = k == "numeric"
        st = (lambda e: e) if num else (lambda e: "CAST(NULL AS DOUBLE)")
        parts.append(f"""
  SELECT '{c}' AS "column", CAST({i} AS BIGINT) AS ordinal, '{k}' AS kind, count({c}) AS n,
         count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct,
         {st(f"avg({x})")} AS mean, {st(f"stddev_samp({x})")} AS sd, {st(f"var_samp({x})")} AS var,
         {st(f"skewness({x})")} AS skew
  FROM {table}""")
    return " UNION ALL ".join(parts)


def _li_profile(spark, sf):
    return column_profile(load(spark, sf, "lineitem").select(*[c for c, _ in LI_KINDS]),
                          with_quantiles=False)


@register("target_candidates", oracle_finish(f"""
WITH p AS ({profile_sql('lineitem', LI_KINDS)})
SELECT "column", ordinal, score, CAST(row_number() OVER (ORDER BY score DESC, ordinal) AS BIGINT) AS "rank"
FROM (SELECT "column", ordinal,
             0.4 * sd / (abs(mean) + 1e-6) + 0.3 * (1 - least(abs(coalesce(skew, 0.0)) / 3, 1.0))
             + 0.3 * (n * 1.0 / (n + n_null)) AS score
      FROM p WHERE kind = 'numeric' AND n_distinct >= 2 AND n >= 10) s""", ["score"]))
def q_target_candidates(spark, sf):
    return finish(S.target_candidates(_li_profile(spark, sf)))


@register("key_variables", oracle_finish(f"""
WITH p AS ({profile_sql('lineitem', LI_KINDS)}),
s AS (
  SELECT "column", kind, ordinal,
         0.4 * least(sd / (abs(mean) + 1e-6), 3.0) / 3 + 0.3 * (n * 1.0 / (n + n_null))
         + CASE WHEN "column" IN ('l_discount') THEN 0.3 ELSE 0.0 END AS score
  FROM p WHERE kind = 'numeric' AND n_distinct >= 2 AND n >= 5
  UNION ALL
  SELECT "column", kind, ordinal,
         0.4 * (1 - n_distinct / 20.0) + 0.4 * (n * 1.0 / (n + n_null))
         + CASE WHEN "column" IN ('l_discount') THEN 0.3 ELSE 0.0 END
  FROM p WHERE kind = 'categorical' AND n_distinct BETWEEN 2 AND 20)
SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY score DESC, ordinal) AS BIGINT) AS "rank" FROM s""", ["score"]))
def q_key_variables(spark, sf):
    return finish(S.key_variables(_li_profile(spark, sf), focus=["l_discount"]))


@register("clustering_variables", oracle_finish(f"""
WITH p AS ({profile_sql('lineitem', LI_KINDS)})
SELECT "column", ordinal, score, CAST(row_number() OVER (ORDER BY score DESC, ordinal) AS BIGINT) AS "rank"
  FROM (SELECT "column", ordinal,
               CASE WHEN abs(mean) > 1e-6 THEN least(sqrt(var) / abs(mean), 1.0) ELSE least(var, 1.0) END * 0.35
               + (n * 1.0 / (n + n_null)) * 0.25 + least(n_distinct / 15.0, 0.5) * 0.20 + 1.0 * 0.10
               + (1 - least(abs(CASE WHEN n > 2 THEN coalesce(skew, 0.0) ELSE 0.0 END) / 6.0, 0.3)) * 0.10 AS score
        FROM p WHERE kind = 'numeric' AND n >= 10 AND var >= 0.001 AND NOT (n_distinct < 3 AND var < 0.1)) s""", ["score"]))
def q_clustering_variables(spark, sf):
    li = load(spark, sf, "lineitem").select(*[c for c, _ in LI_KINDS])
    return finish(S.clustering_variables(li, column_profile(li, with_quantiles=False)))


@register("interaction_candidates", oracle_finish(f"""
WITH p AS ({profile_sql('lineitem', LI_KINDS)})
SELECT "column", ordinal, score, CAST(row_number() OVER (ORDER BY score DESC, ordinal) AS BIGINT) AS "rank"
FROM (SELECT "column", ordinal, CASE WHEN var > 0 THEN var * (n * 1.0 / (n + n_null)) ELSE 0.0 END AS score
      FROM p WHERE kind = 'numeric' AND n >= 20 AND sd >= 0.01) s""", ["score"]))
def q_interaction_candidates(spark, sf):
    return finish(S.interaction_candidates(_li_profile(spark, sf)))


# ---------------------------------------------------------------- P18 / P19 / P20 over a table of texts

EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _context_sql():
    low = "lower(text)"
    any_ = lambda ws: " OR ".join(f"contains({low}, '{w}')" for w in ws)
    target = "CASE " + " ".join(f"WHEN contains({low}, '{c}') THEN '{c}'" for c in EVENT_COLS) + " ELSE 'event_id' END"
    focus = ("array_to_string(list_slice(list_filter([" +
             ", ".join(f"CASE WHEN contains({low}, '{c}') THEN '{c}' END" for c in EVENT_COLS) +
             "], lambda x: x IS NOT NULL), 1, 5), ',')")
    return f"""
SELECT doc_id, CASE WHEN {any_(S.PREDICT_WORDS)} THEN 'regression'
                    WHEN {any_(S.GROUP_WORDS)} THEN 'clustering'
                    WHEN {any_(S.RELATION_WORDS)} THEN 'correlation' ELSE 'descriptive' END AS analysis_type,
       {target} AS target, {focus} AS focus
FROM documents"""


@register("context_rules", _context_sql())
def q_context_rules(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    events = load(spark, sf, "events")
    return S.context_rules(docs, "text", events).drop("text")


# ---------------------------------------------------------------- A1 - A8 on region -> nation -> customer


@register("adm_regions", FX.with_views("SELECT DISTINCT ADM1_EN FROM geo_dim", "geo_dim"))
def q_adm_regions(spark, sf):
    return G.regions(FX.geo_dim(spark, sf))


@register("adm_districts", FX.with_views("""
SELECT ADM2_PCODE AS pcode, arg_min(ADM2_EN, ADM3_PCODE) AS name, arg_min(ADM2_TYPE, ADM3_PCODE) AS type,
       arg_min(ADM1_EN, ADM3_PCODE) AS adm1
FROM geo_dim GROUP BY ADM2_PCODE""", "geo_dim"))
def q_adm_districts(spark, sf):
    return G.districts(FX.geo_dim(spark, sf))


@register("adm_localities", FX.with_views("""
SELECT ADM3_PCODE AS pcode, ADM3_EN AS name, ADM2_EN AS adm2, ADM1_EN AS adm1, ADM2_TYPE AS adm2_type
FROM geo_dim WHERE ADM1_EN = 'AFRICA'""", "geo_dim"))
def q_adm_localities(spark, sf):
    return G.localities(FX.geo_dim(spark, sf), adm1="AFRICA")


@register("adm_statistics", FX.with_views("""
SELECT count(DISTINCT ADM3_PCODE) AS total_locations_adm3, count(DISTINCT ADM2_PCODE) AS total_districts_adm2,
       count(DISTINCT ADM1_EN) AS total_regions_adm1 FROM geo_dim""", "geo_dim"))
def q_adm_statistics(spark, sf):
    return G.statistics(FX.geo_dim(spark, sf))


@register("adm_hierarchy", FX.with_views("""
SELECT ADM1_EN, string_agg(ADM2_EN || ':' || ADM2_PCODE || ':' || CAST(n_localities AS VARCHAR), ';'
                           ORDER BY ADM2_EN, ADM2_PCODE) AS districts,
       CAST(sum(n_localities) AS BIGINT) AS n_localities
FROM (SELECT ADM1_EN, ADM2_PCODE, ADM2_EN, count(DISTINCT ADM3_PCODE) AS n_localities
      FROM geo_dim GROUP BY ALL) d GROUP BY ADM1_EN""", "geo_dim"))
def q_adm_hierarchy(spark, sf):
    h = G.hierarchy_index(FX.geo_dim(spark, sf))
    flat = F.array_join(F.transform("districts", lambda d: F.concat_ws(
        ":", d["ADM2_EN"], d["ADM2_PCODE"], d["n_localities"].cast("string"))), ";")
    return h.select("ADM1_EN", flat.alias("districts"), F.col("n_localities").cast("long"))


def _contexts(spark, sf):
    """Location requests derived from orders: the priority text decides rural / urban / all."""
    o = load(spark, sf, "orders")
    txt = (F.when(F.col("o_orderpriority").startswith("1"), F.lit("zones rurales"))
           .when(F.col("o_orderpriority").startswith("2"), F.lit("centre ville"))
           .otherwise(F.concat(F.lit("enquête "), F.col("o_orderpriority"))))
    return o.select(F.col("o_orderkey").alias("key"), txt.alias("text"))


@register("adm_district_localities", FX.with_views("""
SELECT DISTINCT ADM2_EN AS adm2, ADM3_PCODE AS pcode, ADM3_EN AS name, ADM1_EN AS adm1 FROM geo_dim
WHERE coalesce(ADM1_EN, '') <> '' AND coalesce(ADM2_EN, '') <> ''""", "geo_dim"))
def q_adm_district_localities(spark, sf):
    return G.district_localities(FX.geo_dim(spark, sf))


@register("adm_locality_details", FX.with_views("""
SELECT ADM3_EN AS adm3, min(ADM3_PCODE) AS pcode, arg_min(ADM1_EN, ADM3_PCODE) AS adm1, arg_min(ADM2_EN, ADM3_PCODE) AS adm2
FROM geo_dim WHERE coalesce(ADM1_EN, '') <> '' AND coalesce(ADM2_EN, '') <> '' GROUP BY ADM3_EN""", "geo_dim"))
def q_adm_locality_details(spark, sf):
    return G.locality_details(FX.geo_dim(spark, sf))


@register("adm_context_search", FX.with_views("""
WITH f AS (SELECT ADM3_PCODE, arg_min(ADM3_EN, ADM2_PCODE) AS ADM3_EN, arg_min(ADM2_EN, ADM2_PCODE) AS ADM2_EN,
                  arg_min(ADM1_EN, ADM2_PCODE) AS ADM1_EN, arg_min(ADM2_TYPE, ADM2_PCODE) AS ADM2_TYPE
           FROM geo_dim GROUP BY ADM3_PCODE),
c AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY ADM3_PCODE) AS "rank" FROM (
        SELECT *, 'rural' AS mode FROM f WHERE NOT regexp_matches(ADM2_EN, '1er|2e|3e|4e|5e|6e')
        UNION ALL SELECT *, 'urban' FROM f WHERE regexp_matches(ADM2_EN, '1er|2e|3e')
        UNION ALL SELECT *, 'all' FROM f) u),
q AS (SELECT o_orderkey AS key,
             CASE WHEN o_orderpriority LIKE '1%' THEN 'rural' WHEN o_orderpriority LIKE '2%' THEN 'urban'
                  ELSE 'all' END AS mode FROM orders)
SELECT q.key, q.mode, CAST(c."rank" AS INTEGER) AS "rank", c.ADM3_PCODE AS pcode, c.ADM3_EN AS name,
       c.ADM2_EN AS adm2, c.ADM1_EN AS adm1, c.ADM2_TYPE AS adm2_type
FROM q JOIN c ON q.mode = c.mode WHERE c."rank" <= 5""", "geo_dim"))
def q_adm_context_search(spark, sf):
    return G.context_locations(FX.geo_dim(spark, sf), _contexts(spark, sf), "text", "key", n=5)


def _supplier_requests(spark, sf):
    s, n = load(spark, sf, "supplier"), load(spark, sf, "nation")
    txt = (F.when(F.col("s_suppkey") % 9 == 0, F.lit("partout à madagascar"))
           .when(F.col("s_suppkey") % 9 == 1, F.lit("madagascar"))
           .otherwise(F.concat_ws(" ", F.lower(F.col("n_name")), F.lit("zone"))))
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("key"), txt.alias("text"))


def _alias_sql():
    aliases = ", ".join(f"('{k}', {i}, '{t}')" for k, ts in G.ALIASES.items() for i, t in enumerate(ts))
    national = " OR ".join(f"contains(lower(trim(text)), '{w.replace(chr(39), chr(39) * 2)}')" for w in G.NATIONAL_KEYWORDS)
    return FX.with_views(f"""
WITH req AS (
  SELECT s_suppkey AS key,
         CASE WHEN s_suppkey % 9 = 0 THEN 'partout à madagascar' WHEN s_suppkey % 9 = 1 THEN 'madagascar'
              ELSE lower(n_name) || ' zone' END AS text
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
flags AS (SELECT key, ({national}) AS national, text FROM req),
words AS (SELECT key, national, unnest(regexp_split_to_array(regexp_replace(lower(trim(text)), ',', ' ', 'g'), '\\s+')) AS word
          FROM flags),
amap(word, apos, term) AS (VALUES {aliases}),
terms AS (SELECT DISTINCT w.key, coalesce(a.term, w.word) AS term FROM words w LEFT JOIN amap a ON w.word = a.word
          WHERE length(w.word) > 3 AND w.word NOT IN ('madagascar', 'mada') AND NOT w.national),
loc AS (SELECT ADM3_PCODE, ADM3_EN, ADM1_EN, ADM2_EN,
               lower(ADM1_EN || chr(1) || ADM2_EN || chr(1) || ADM3_EN) AS hay FROM geo_dim),
hits AS (SELECT DISTINCT t.key, l.ADM3_PCODE, l.ADM3_EN, l.ADM1_EN, l.ADM2_EN FROM terms t JOIN loc l
         ON contains(l.hay, lower(t.term))),
npool AS (SELECT ADM3_PCODE, ADM3_EN, ADM1_EN, ADM2_EN FROM loc ORDER BY md5(ADM3_PCODE), ADM3_PCODE LIMIT 5),
dpool AS (SELECT ADM3_PCODE, ADM3_EN, ADM1_EN, ADM2_EN FROM loc WHERE contains(lower(ADM1_EN), 'africa')
          ORDER BY md5(ADM3_PCODE), ADM3_PCODE LIMIT 5),
cand AS (
  SELECT * FROM hits
  UNION ALL SELECT f.key, p.* FROM flags f, npool p WHERE f.national
  UNION ALL SELECT f.key, p.* FROM flags f, dpool p
            WHERE NOT f.national AND f.key NOT IN (SELECT key FROM hits)),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(ADM3_PCODE), ADM3_PCODE) AS r
                          FROM cand) x WHERE r <= 5)
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY ADM3_EN, ADM3_PCODE) AS INTEGER) AS "rank",
       ADM3_PCODE AS pcode, ADM3_EN AS name, ADM1_EN AS adm1, ADM2_EN AS adm2
FROM picked""", "geo_dim")


@register("adm_alias_search", _alias_sql())
def q_adm_alias_search(spark, sf):
    """A5: alias-expanded substring search with national / default fallbacks and an
    md5-ordered sample of 5 per request."""
    return G.alias_search(FX.geo_dim(spark, sf), _supplier_requests(spark, sf), "text", "key",
                          n=5, default_region="AFRICA")


@register("adm_zone_filter", FX.with_views("""
SELECT * FROM geo_dim WHERE ADM1_EN IN ('AMERICA', 'NATION_4') OR ADM2_EN IN ('AMERICA', 'NATION_4')""", "geo_dim"))
def q_adm_zone_filter(spark, sf):
    """Exact zone filter on level 1 or 2 (falls back to every row when nothing matches)."""
    return G.zone_filter(FX.geo_dim(spark, sf), ["AMERICA", "NATION_4"])


@register("drop_high_cardinality", """
SELECT p_partkey, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part""")
def q_drop_high_cardinality(spark, sf):
    """strings with more than 50 distinct values are dropped (p_name here)."""
    from quarry.operators.prepare import distinct_counts
    p = load(spark, sf, "part")
    strings = [f.name for f in p.schema.fields if f.dataType.simpleString() == "string"]
    dc = distinct_counts(p, strings)
    return finish(p.drop(*[c for c in strings if dc[c] > 50]))


def _scratch(spark, name):
    import uuid
    from quarry.session import checkpoint_dir
    return f"{checkpoint_dir(spark)}/{name}_{uuid.uuid4().hex[:8]}"


@register("csv_roundtrip", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def q_csv_roundtrip(spark, sf):
    """S4 + S1: header CSV sink, read back with the ','/UTF-8 then ';'/ISO-8859-1 dialect
    choice and an explicit schema."""
    from quarry.sources.delimited import read_delimited
    from quarry.sources.sinks import write_csv
    path = _scratch(spark, "csv")
    c = load(spark, sf, "customer")
    write_csv(c, path)
    back = read_delimited(spark, path, schema="c_custkey long, c_name string, c_nationkey long, "
                                              "c_acctbal double, c_mktsegment string")
    return finish(back)


@register("tsv_adm_roundtrip", FX.with_views("""
SELECT trim(ADM1_EN) AS ADM1_EN, trim(ADM2_EN) AS ADM2_EN, ADM2_PCODE, ADM2_TYPE, trim(ADM3_EN) AS ADM3_EN, ADM3_PCODE
FROM geo_dim""", "geo_dim"))
def q_tsv_adm_roundtrip(spark, sf):
    """S2 + S3: the hierarchy written as TSV and as CSV, read back as TSV and as the
    all-string administrative dimension (names trimmed)."""
    from quarry.sources.delimited import read_adm_dimension, read_tsv
    p1, p2 = _scratch(spark, "tsv"), _scratch(spark, "adm")
    dim = FX.geo_dim(spark, sf)
    dim.write.option("header", True).option("sep", "\t").csv(p1)
    read_tsv(spark, p1).write.option("header", True).csv(p2)
    return read_adm_dimension(spark, p2)


@register("json_sink_roundtrip", """
SELECT COUNT(*) AS n_surveys FROM (SELECT DISTINCT CAST(floor(p_partkey / 50) AS BIGINT) FROM part) s""")
def q_json_sink_roundtrip(spark, sf):
    """Whole nested surveys written as JSON and read back with their schema."""
    from quarry.sources.sinks import write_json
    path = _scratch(spark, "json")
    s = FX.survey_nested(spark, sf)
    write_json(s, path)
    back = spark.read.schema(s.schema).json(path)
    return back.agg(F.count(F.lit(1)).alias("n_surveys"))
