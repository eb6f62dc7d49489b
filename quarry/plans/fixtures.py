"""Deterministic derived inputs built from the driver tables.

The driver tables have no nulls, no duplicates and nearly uncorrelated numerics, so the
operators that react to those conditions are exercised on views derived by fixed
expressions. Each view exists twice with the same expression: a Spark builder (used by
``queries()``) and a DuckDB SQL text (used by ``oracle_sql()``). All views keep every row
of their base table; the modulo expressions only decide *which value* a row gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import load

# ---------------------------------------------------------------- Spark builders


def dirty_customer(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    m11 = F.col("c_custkey") % 11
    seg = (F.when(m11 == 0, F.lit("")).when(m11 == 1, F.lit("  ")).when(m11 == 2, F.lit("NA"))
           .when(m11 == 3, F.lit("null")).otherwise(F.col("c_mktsegment")))
    bal = F.when(F.col("c_custkey") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal"))
    return c.select("c_custkey", "c_name", "c_nationkey", bal.alias("c_acctbal"), seg.alias("c_mktsegment"))


def sparse_customer(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    keep = F.col("c_custkey") % 50 == 0
    return c.select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
        F.when(keep, F.concat(F.lit("R"), F.col("c_custkey").cast("string"))).alias("ref_id"),
        F.when(keep, F.col("c_name")).alias("note"),
        F.when(keep, F.lit("1")).alias("opt"),
        F.when(keep, F.lit("x")).alias("konst"),
        F.lit(None).cast("string").alias("empty_col"))


def dup_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return o.unionByName(o.filter(F.col("o_orderkey") % 10 == 0))


def text_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_totalprice",
        F.concat(F.lit("  "), F.upper("o_orderpriority"), F.lit("  x")).alias("priority_text"),
        F.when(F.col("o_orderkey") % 13 == 0, F.lit("junk"))
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("order_date"))


def corr_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (-F.col("l_extendedprice")).alias("neg"),
        (F.col("l_extendedprice") / 2 + 100 * F.col("l_quantity")).alias("half"),
        F.lit(1.0).alias("const"))


def skew_events(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    return e.select("event_id", "user_id", "event_type", "value",
                    (F.col("value") * F.col("value") * F.col("value")).alias("value3"))


def outlier_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    price = F.when(F.col("o_orderkey") % 40 == 0, F.col("o_totalprice") * 20).otherwise(F.col("o_totalprice"))
    return o.select("o_orderkey", "o_custkey", price.alias("o_totalprice"), "o_orderstatus",
                    "o_orderpriority")


def age_customer(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    return c.select("c_custkey", "c_acctbal", "c_mktsegment",
                    (F.col("c_custkey") % 130 - 10).alias("age"))


def flags_part(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part")

    def flag(m):
        return F.when(F.col("p_size") % m == 0, F.lit("Eny")).otherwise(F.lit("Tsia"))
    return p.select("p_partkey", "p_size", "p_retailprice",
                    flag(2).alias("q_a_b_c_x"), flag(3).alias("q_a_b_c_y"), flag(5).alias("q_a_b_c_z"))


def geo_dim(spark: SparkSession, sf: str) -> DataFrame:
    """region -> nation -> customer as a 3-level administrative hierarchy (A3 schema)."""
    r, n, c = load(spark, sf, "region"), load(spark, sf, "nation"), load(spark, sf, "customer")
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("r_name").alias("ADM1_EN"), F.col("n_name").alias("ADM2_EN"),
                    F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ADM2_PCODE"),
                    F.col("c_mktsegment").alias("ADM2_TYPE"),
                    F.col("c_name").alias("ADM3_EN"),
                    F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ADM3_PCODE")))


def given_labels(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                     "l_tax", (F.col("l_linenumber") % 3).cast("int").alias("cluster"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    shifted = (F.when(F.col("o_orderstatus") == "F", F.lit("O"))
               .when(F.col("o_orderstatus") == "O", F.lit("P")).otherwise(F.lit("F")))
    return o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("model"),
                    F.col("o_orderstatus").alias("label"),
                    F.when(F.col("o_orderkey") % 5 == 0, shifted).otherwise(F.col("o_orderstatus"))
                    .alias("prediction"),
                    F.col("o_totalprice").alias("y"),
                    (F.col("o_totalprice") * (1 + ((F.col("o_orderkey") % 7) - 3) / 100.0)).alias("y_hat"),
                    (F.when(F.col("o_orderkey") % 10 < 6, F.lit("train"))
                     .when(F.col("o_orderkey") % 10 < 8, F.lit("val")).otherwise(F.lit("test")))
                    .alias("split"))


def stage_events(spark: SparkSession, sf: str) -> DataFrame:
    """events as analysis-stage events: event_type -> stage, user_id -> file_id."""
    e = load(spark, sf, "events")
    et = F.col("event_type")
    stage = (F.when(et.isin("view", "click"), F.lit("file_structure"))
             .when(et.isin("purchase", "signup"), F.lit("eda")).otherwise(F.lit("full_analysis")))
    return e.select(F.col("user_id").alias("file_id"), stage.alias("stage"),
                    F.when(et == "error", F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
                    F.col("ts").cast("timestamp").alias("ts"), "event_id")


# ---------------------------------------------------------------- DuckDB texts (oracle)

SQL = {
    "dirty_customer": """
        SELECT c_custkey, c_name, c_nationkey,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
               CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN 'NA'
                    WHEN 3 THEN 'null' ELSE c_mktsegment END AS c_mktsegment
        FROM customer""",
    "sparse_customer": """
        SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
               CASE WHEN c_custkey % 50 = 0 THEN 'R' || CAST(c_custkey AS VARCHAR) END AS ref_id,
               CASE WHEN c_custkey % 50 = 0 THEN c_name END AS note,
               CASE WHEN c_custkey % 50 = 0 THEN '1' END AS opt,
               CASE WHEN c_custkey % 50 = 0 THEN 'x' END AS konst,
               CAST(NULL AS VARCHAR) AS empty_col
        FROM customer""",
    "dup_orders": "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0",
    "text_orders": """
        SELECT o_orderkey, o_custkey, o_totalprice,
               '  ' || upper(o_orderpriority) || '  x' AS priority_text,
               CASE WHEN o_orderkey % 13 = 0 THEN 'junk' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS order_date
        FROM orders""",
    "corr_lineitem": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
               l_returnflag, l_linestatus,
               l_extendedprice * (1 - l_discount) AS net, -l_extendedprice AS neg,
               l_extendedprice / 2 + 100 * l_quantity AS half, 1.0::DOUBLE AS const
        FROM lineitem""",
    "skew_events": "SELECT event_id, user_id, event_type, value, value * value * value AS value3 FROM events",
    "outlier_orders": """
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderkey % 40 = 0 THEN o_totalprice * 20 ELSE o_totalprice END AS o_totalprice,
               o_orderstatus, o_orderpriority
        FROM orders""",
    "age_customer": "SELECT c_custkey, c_acctbal, c_mktsegment, c_custkey % 130 - 10 AS age FROM customer",
    "flags_part": """
        SELECT p_partkey, p_size, p_retailprice,
               CASE WHEN p_size % 2 = 0 THEN 'Eny' ELSE 'Tsia' END AS q_a_b_c_x,
               CASE WHEN p_size % 3 = 0 THEN 'Eny' ELSE 'Tsia' END AS q_a_b_c_y,
               CASE WHEN p_size % 5 = 0 THEN 'Eny' ELSE 'Tsia' END AS q_a_b_c_z
        FROM part""",
    "geo_dim": """
        SELECT r_name AS ADM1_EN, n_name AS ADM2_EN, 'N' || CAST(n_nationkey AS VARCHAR) AS ADM2_PCODE,
               c_mktsegment AS ADM2_TYPE, c_name AS ADM3_EN, 'C' || CAST(c_custkey AS VARCHAR) AS ADM3_PCODE
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "given_labels": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
               CAST(l_linenumber % 3 AS INTEGER) AS cluster
        FROM lineitem""",
    "predictions": """
        SELECT o_orderkey AS row_id, o_orderpriority AS model, o_orderstatus AS label,
               CASE WHEN o_orderkey % 5 = 0 THEN
                    CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'P' ELSE 'F' END
                    ELSE o_orderstatus END AS prediction,
               o_totalprice AS y,
               o_totalprice * (1 + ((o_orderkey % 7) - 3) / 100.0) AS y_hat,
               CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'val'
                    ELSE 'test' END AS split
        FROM orders""",
    "stage_events": """
        SELECT user_id AS file_id,
               CASE WHEN event_type IN ('view', 'click') THEN 'file_structure'
                    WHEN event_type IN ('purchase', 'signup') THEN 'eda' ELSE 'full_analysis' END AS stage,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
               ts, event_id
        FROM events""",
}


def with_views(sql: str, *views: str) -> str:
    """Prefix an oracle query with the CTEs of the derived views it reads."""
    if not views:
        return sql
    ctes = ",\n".join(f"{v} AS ({SQL[v]})" for v in views)
    body = sql.lstrip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{sql}"


# ---------------------------------------------------------------- nested questionnaires

SURVEY_BLOCK = 50
Q_TYPES6 = ["single_choice", "multiple_choice", "text", "yes_no", "date", "number"]


def survey_nested(spark: SparkSession, sf: str) -> DataFrame:
    """One survey per block of 50 parts (bounded nesting, survey count grows with the data):
    p_brand -> categories, parts -> questions, 2 + p_size % 3 answers, type from p_size % 6."""
    p = load(spark, sf, "part")
    sid = F.floor(F.col("p_partkey") / SURVEY_BLOCK).cast("long")
    qtype = F.element_at(F.array(*[F.lit(t) for t in Q_TYPES6]), (F.col("p_size") % 6 + 1).cast("int"))
    answers = F.transform(F.sequence(F.lit(1), F.lit(2) + F.col("p_size") % 3), lambda i: F.struct(
        F.concat(F.lit("a"), F.col("p_partkey").cast("string"), F.lit("_"), i.cast("string")).alias("answer_id"),
        F.lit("option").alias("answer_type"),
        F.concat(F.col("p_name"), F.lit(" #"), i.cast("string")).alias("answer_text"),
        F.lit(None).cast("string").alias("next_question_id")))
    question = F.struct(
        F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("question_id"), qtype.alias("question_type"),
        F.concat(F.col("p_name"), F.lit(" ?")).alias("question_text"), (F.col("p_size") % 2 == 0).alias("is_required"),
        F.lit(None).cast("string").alias("help_text"), F.lit(None).cast("string").alias("predecessor_answer_id"),
        answers.alias("expected_answers"))
    cats = (p.select(sid.alias("survey_id"), "p_brand", "p_partkey", question.alias("q"))
            .groupBy("survey_id", "p_brand")
            .agg(F.array_sort(F.collect_list(F.struct("p_partkey", "q"))).alias("qs")))
    category = F.struct(
        F.concat(F.col("survey_id").cast("string"), F.lit("_"), F.regexp_replace("p_brand", "#", "")).alias("category_id"),
        F.col("p_brand").alias("category_name"), F.concat(F.lit("Marque "), F.col("p_brand")).alias("description"),
        F.substring_index("p_brand", "#", -1).cast("int").alias("order"),
        F.transform("qs", lambda x: x["q"]).alias("questions"))
    surveys = (cats.select("survey_id", "p_brand", category.alias("c")).groupBy("survey_id")
               .agg(F.array_sort(F.collect_list(F.struct("p_brand", "c"))).alias("cs")))
    meta = F.struct(F.concat(F.lit("Enquête "), F.col("survey_id").cast("string")).alias("title"),
                    F.lit("Introduction").alias("introduction"), F.lit("30 min").alias("survey_total_duration"),
                    F.lit(100).alias("number_of_respondents"), F.lit(5).alias("number_of_investigators"),
                    F.lit(1).alias("number_of_locations"))
    loc = F.array(F.struct(F.concat(F.lit("L"), F.col("survey_id").cast("string")).alias("pcode"),
                           F.lit("Lieu").alias("name"), F.lit("R").alias("adm1"), F.lit("D").alias("adm2"),
                           F.lit(None).cast("string").alias("adm3"), F.lit(None).cast("double").alias("latitude"),
                           F.lit(None).cast("double").alias("longitude")))
    return surveys.select("survey_id", meta.alias("metadata"), F.transform("cs", lambda x: x["c"]).alias("categories"),
                          loc.alias("locations"), F.lit("1.0").alias("version"))


def llm_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Generated-record texts derived from the surveys: plain list, fenced list, object in
    prose, truncated list and flat question list, by survey_id % 5."""
    s = survey_nested(spark, sf)
    raw_q = lambda q: F.struct(q["question_text"].alias("question_text"), q["question_type"].alias("type"),
                               F.transform(q["expected_answers"], lambda a: a["answer_text"]).alias("options"))
    cats = F.transform("categories", lambda c: F.struct(c["category_name"].alias("category_name"),
                                                        F.transform(c["questions"], raw_q).alias("questions")))
    flat = F.flatten(F.transform("categories", lambda c: F.transform(
        c["questions"], lambda q: F.struct(q["question_text"].alias("question"), q["question_type"].alias("type"),
                                           F.transform(q["expected_answers"], lambda a: a["answer_text"]).alias("options")))))
    js = F.to_json(cats)
    m = F.col("survey_id") % 5
    text = (F.when(m == 0, js)
            .when(m == 1, F.concat(F.lit("```json\n"), js, F.lit("\n```")))
            .when(m == 2, F.concat(F.lit("Voici le questionnaire : "), F.to_json(F.struct(cats.alias("categories"))),
                                   F.lit(" Bonne enquête.")))
            .when(m == 3, F.substring(js, 1, F.length(js) - 3))
            .otherwise(F.to_json(flat)))
    req = F.transform("categories", lambda c: c["category_name"])
    return s.select(F.col("survey_id").alias("response_id"), req.alias("requested_categories"), text.alias("text"))
