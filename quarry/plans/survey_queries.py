"""Registered questionnaire (Q1-Q14) and text-scalar (X1-X3) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import survey as Q
from quarry.plans import fixtures as FX
from quarry.plans.common import finish, register
from quarry.sources.tables import load

# flattened questionnaire rows computed directly from part (the oracle's view of the fixture)
SQ = """sq AS (
SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS survey_id, p_brand, p_partkey, p_name, p_size,
       CAST(dense_rank() OVER (PARTITION BY floor(p_partkey / 50) ORDER BY p_brand) - 1 AS BIGINT) AS cat_pos,
       CAST(row_number() OVER (PARTITION BY floor(p_partkey / 50), p_brand ORDER BY p_partkey) - 1 AS BIGINT) AS q_pos,
       'q' || CAST(p_partkey AS VARCHAR) AS question_id,
       ['single_choice','multiple_choice','text','yes_no','date','number'][p_size % 6 + 1] AS qtype,
       p_name || ' ?' AS question_text, p_size % 2 = 0 AS is_required, 2 + p_size % 3 AS n_answers
FROM part)"""


def _surveys(spark, sf):
    return FX.survey_nested(spark, sf)


@register("survey_flatten", f"""WITH {SQ}
SELECT survey_id, cat_pos, q_pos, p_brand AS category, question_text AS question, qtype AS type,
       is_required AS required, question_id,
       array_to_string(list_transform(range(1, n_answers + 1), lambda i: p_name || ' #' || CAST(i AS VARCHAR)), ', ') AS options
FROM sq""")
def q_survey_flatten(spark, sf):
    return finish(Q.flatten(_surveys(spark, sf)))


@register("xlsform_survey", f"""WITH {SQ}
SELECT DISTINCT survey_id, cat_pos, CAST(0 AS BIGINT) AS part, CAST(-1 AS BIGINT) AS q_pos, 'begin_group' AS type,
       lower(replace(substr('grp_' || CAST(survey_id AS VARCHAR) || '_' || replace(p_brand, '#', ''), 1, 30), ' ', '_')) AS name,
       p_brand AS label, CAST(NULL AS VARCHAR) AS required FROM sq
UNION ALL
SELECT survey_id, cat_pos, 1, q_pos,
       CASE WHEN qtype IN ('single_choice', 'yes_no') THEN 'select_one list_q_' || question_id
            WHEN qtype = 'multiple_choice' THEN 'select_multiple list_q_' || question_id
            WHEN qtype = 'number' THEN 'integer' WHEN qtype = 'date' THEN 'date'
            WHEN contains(qtype, 'gps') THEN 'geopoint' ELSE 'text' END,
       'q_' || question_id, question_text, CASE WHEN is_required THEN 'true' ELSE 'false' END FROM sq
UNION ALL
SELECT DISTINCT survey_id, cat_pos, 2, -1, 'end_group', NULL, NULL, NULL FROM sq""")
def q_xlsform_survey(spark, sf):
    return finish(Q.xlsform_survey(_surveys(spark, sf)))


@register("xlsform_choices", f"""WITH {SQ}
SELECT survey_id, cat_pos, q_pos, CAST(i - 1 AS BIGINT) AS a_pos, 'list_q_' || question_id AS list_name,
       'a' || CAST(p_partkey AS VARCHAR) || '_' || CAST(i AS VARCHAR) AS name, p_name || ' #' || CAST(i AS VARCHAR) AS label
FROM (SELECT *, unnest(range(1, n_answers + 1)) AS i FROM sq WHERE qtype IN ('single_choice', 'yes_no', 'multiple_choice')) t""")
def q_xlsform_choices(spark, sf):
    return finish(Q.xlsform_choices(_surveys(spark, sf)))


@register("xlsform_settings", """
SELECT DISTINCT CAST(floor(p_partkey / 50) AS BIGINT) AS survey_id,
       'Enquête ' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS VARCHAR) AS form_title,
       'kobo_id_v1' AS form_id, 'French (fr)' AS default_language FROM part""")
def q_xlsform_settings(spark, sf):
    return Q.xlsform_settings(_surveys(spark, sf))


@register("survey_metadata", """
SELECT DISTINCT CAST(floor(p_partkey / 50) AS BIGINT) AS survey_id, 'Enquête ' || CAST(floor(p_partkey / 50) AS BIGINT) AS title,
       'Introduction' AS introduction, '30 min' AS survey_total_duration, CAST(100 AS BIGINT) AS number_of_respondents,
       CAST(5 AS BIGINT) AS number_of_investigators, CAST(1 AS BIGINT) AS number_of_locations FROM part""")
def q_survey_metadata(spark, sf):
    return finish(Q.survey_metadata(_surveys(spark, sf)))


@register("survey_locations", """
SELECT DISTINCT CAST(floor(p_partkey / 50) AS BIGINT) AS survey_id, CAST(0 AS BIGINT) AS loc_pos,
       'L' || CAST(floor(p_partkey / 50) AS BIGINT) AS pcode, 'Lieu' AS name, 'R' AS adm1, 'D' AS adm2, CAST(NULL AS VARCHAR) AS adm3,
       CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude FROM part""")
def q_survey_locations(spark, sf):
    return finish(Q.survey_locations(_surveys(spark, sf)))


@register("form_items", f"""WITH {SQ},
sz AS (SELECT survey_id, cat_pos, count(*) + 1 AS w, min(p_brand) AS brand FROM sq GROUP BY survey_id, cat_pos),
off AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY survey_id ORDER BY cat_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM sz)
SELECT survey_id, CAST(o AS BIGINT) AS "index", 'PAGE_BREAK' AS kind, brand AS title FROM off
UNION ALL
SELECT sq.survey_id, CAST(o + q_pos + 1 AS BIGINT),
       CASE WHEN qtype IN ('single_choice', 'yes_no') THEN 'RADIO' WHEN qtype = 'multiple_choice' THEN 'CHECKBOX'
            WHEN qtype = 'date' THEN 'DATE' ELSE 'PARAGRAPH' END, question_text
FROM sq JOIN off ON sq.survey_id = off.survey_id AND sq.cat_pos = off.cat_pos""")
def q_form_items(spark, sf):
    return finish(Q.form_items(_surveys(spark, sf)))


@register("survey_counts", f"""WITH {SQ}
SELECT survey_id, count(DISTINCT p_brand) AS n_categories, count(*) AS n_questions, CAST(1 AS BIGINT) AS n_locations
FROM sq GROUP BY survey_id""")
def q_survey_counts(spark, sf):
    return finish(Q.survey_counts(_surveys(spark, sf)))


REQUESTED = ["Brand#3", "Brand#1", "Brand#2"]


@register("category_order", f"""WITH {SQ}
SELECT DISTINCT survey_id, cat_pos, p_brand AS category,
       CAST(CASE p_brand WHEN 'Brand#3' THEN 1 WHEN 'Brand#1' THEN 2 WHEN 'Brand#2' THEN 3 ELSE 999 END AS BIGINT) AS order_key
FROM sq""")
def q_category_order(spark, sf):
    return finish(Q.category_order(_surveys(spark, sf), REQUESTED))


def _requests(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey",
                    F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_orderkey") % 100).alias("asked_questions"),
                    F.when(F.col("o_custkey") % 11 == 0, F.lit(None)).otherwise(F.col("o_custkey") % 30).alias("asked_locations"))


@register("clamp_requests", """
SELECT o_orderkey, asked_questions, asked_locations,
       CAST(greatest(24, least(coalesce(asked_questions, 50), 60)) AS BIGINT) AS num_questions,
       CAST(greatest(3, least(coalesce(asked_locations, 5), 20)) AS BIGINT) AS num_locations
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 100 END AS asked_questions,
             CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey % 30 END AS asked_locations FROM orders) r""")
def q_clamp_requests(spark, sf):
    return Q.clamp_requests(_requests(spark, sf), "asked_questions", "asked_locations")


@register("pick_attempt", f"""WITH {SQ},
a AS (SELECT survey_id // 3 AS request, survey_id % 3 AS attempt, count(*) AS n_questions, count(DISTINCT p_brand) >= 20 AS valid
      FROM sq GROUP BY survey_id)
SELECT request, coalesce(min(CASE WHEN valid AND n_questions >= 25 THEN attempt END), max(attempt)) AS chosen_attempt,
       min(CASE WHEN valid AND n_questions >= 25 THEN attempt END) IS NOT NULL AS sufficient
FROM a GROUP BY request""")
def q_pick_attempt(spark, sf):
    s = _surveys(spark, sf)
    c = Q.survey_counts(s)
    att = c.select((F.col("survey_id") / 3).cast("long").alias("request"), (F.col("survey_id") % 3).alias("attempt"),
                   F.col("n_questions"), (F.col("n_categories") >= 20).alias("valid"))
    return Q.pick_attempt(att, "request", "attempt", "n_questions", "valid")


@register("normalize_responses")
def q_normalize_responses(spark, sf):
    """Q7-Q10 over generated texts (fenced, in prose, truncated, flat lists); rows-only, the
    parsing ladder is unit-tested against Python's json."""
    r = FX.llm_responses(spark, sf)
    return Q.normalize_responses(r, "response_id", "text", "requested_categories")


@register("valid_insights", """
SELECT doc_id, source AS title, text AS summary, lang AS recommendation FROM documents
WHERE length(trim(coalesce(source, ''))) > 0 AND length(trim(coalesce(text, ''))) > 0
  AND length(trim(coalesce(lang, ''))) > 0""")
def q_valid_insights(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("summary"),
                                            F.col("lang").alias("recommendation"))
    return Q.valid_insights(d)


# ---------------------------------------------------------------- X1 - X3 over documents


@register("markdown_strip", f"""
SELECT doc_id, {X.markdown_strip_sql('text')} AS plain FROM documents""")
def q_markdown_strip(spark, sf):
    from quarry.operators.profile import spread
    d = spread(load(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", X.markdown_strip(F.col("text")).alias("plain"))


@register("typographic_fold", f"""
SELECT doc_id, {X.fold_sql('text')} AS folded FROM documents""")
def q_typographic_fold(spark, sf):
    from quarry.operators.profile import spread
    d = spread(load(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", X.typographic_fold(F.col("text")).alias("folded"))


@register("location_phrase", """
WITH g AS (SELECT r_name AS region, n_name AS district, c_mktsegment AS commune
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT list(v ORDER BY v) AS vs FROM (SELECT v FROM (SELECT DISTINCT trim(region) AS v FROM g UNION SELECT DISTINCT trim(district) FROM g) u ORDER BY v LIMIT 3) t),
c AS (SELECT list(v ORDER BY v) AS vs FROM (SELECT DISTINCT trim(commune) AS v FROM g ORDER BY v LIMIT 5) t)
SELECT CASE WHEN len(r.vs) = 0 AND len(c.vs) = 0 THEN 'sur plusieurs localités' ELSE
  concat(CASE WHEN len(r.vs) = 1 THEN 'dans la région de ' || r.vs[1]
              WHEN len(r.vs) > 1 THEN 'dans les régions de ' || array_to_string(r.vs, ' et ') ELSE '' END,
         CASE WHEN len(c.vs) > 0 AND len(r.vs) > 0 THEN ', ' ELSE '' END,
         CASE WHEN len(c.vs) = 1 THEN 'notamment la commune de ' || c.vs[1]
              WHEN len(c.vs) > 1 THEN 'notamment les communes de ' || array_to_string(c.vs, ' et ') ELSE '' END) END AS phrase
FROM r, c""")
def q_location_phrase(spark, sf):
    from quarry.operators.geo import extract_locations
    from quarry.plans.clean_queries import _geo_table
    loc = extract_locations(_geo_table(spark, sf))
    arrays = loc.groupBy().agg(
        F.array_sort(F.collect_list(F.when(F.col("level") == "region", F.col("value")))).alias("regions"),
        F.array_sort(F.collect_list(F.when(F.col("level") == "commune", F.col("value")))).alias("communes"))
    return arrays.select(X.location_phrase(F.col("regions"), F.col("communes")).alias("phrase"))
