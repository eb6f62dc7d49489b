"""Generated-record parsing against Python's json, and alias search against brute force."""

import json
import re

from pyspark.sql import functions as F

from conftest import SF_TINY
from quarry.operators import geo as G
from quarry.operators import survey as Q
from quarry.plans import fixtures as FX


def _python_count(text):
    t = re.sub(r"```json", "", text, flags=re.IGNORECASE)
    t = re.sub(r"```", "", t).strip()
    for cand in (t, (re.search(r"\[.*\]", t, re.S) or [None])[0], (re.search(r"\{.*\}", t, re.S) or [None])[0]):
        if not cand:
            continue
        try:
            data = json.loads(cand)
        except ValueError:
            continue
        if isinstance(data, dict):
            data = data.get("categories") or [data]
        if data and isinstance(data[0], dict) and "questions" not in data[0]:
            return len(data)
        return sum(len(c.get("questions", [])) for c in data)
    return 0


def test_normalized_question_counts_match_python(spark):
    r = FX.llm_responses(spark, SF_TINY)
    got = {row[0]: row[1] for row in Q.normalize_responses(r, "response_id", "text", "requested_categories")
           .groupBy("response_id").count().collect()}
    for row in r.collect():
        assert got.get(row["response_id"], 0) == _python_count(row["text"]), row["response_id"]


def test_alias_search_matches_brute_force(spark):
    dim = FX.geo_dim(spark, SF_TINY)
    qs = spark.createDataFrame([(1, "nation_3 zone"), (2, "partout"), (3, "madagascar")], "key long, text string")
    got = G.alias_search(dim, qs, "text", "key", n=5, default_region="AFRICA").collect()
    rows = dim.collect()
    hits1 = {r["ADM3_PCODE"] for r in rows if any("nation_3" in (r[c] or "").lower()
                                                  for c in ("ADM1_EN", "ADM2_EN", "ADM3_EN"))}
    k1 = [g for g in got if g["key"] == 1]
    assert len(k1) == min(5, len(hits1)) and all(g["pcode"] in hits1 for g in k1)
    assert len([g for g in got if g["key"] == 2]) == 5
    africa = {r["ADM3_PCODE"] for r in rows if "africa" in r["ADM1_EN"].lower()}
    assert all(g["pcode"] in africa for g in got if g["key"] == 3)


def test_object_of_lists(spark):
    from quarry.operators.survey import normalize_responses
    text = '{"Santé": [{"question": "Q1", "type": "radio"}], "Eau": [{"text": "Q2"}, {"label": "Q3"}]}'
    plain = '{"category_name": "Seule", "questions": [{"question": "Q4"}]}'
    df = spark.createDataFrame([(1, text, ["A"]), (2, plain, ["A"])], "k long, t string, req array<string>")
    got = {(r["k"], r["category_name"], r["question_text"]) for r in normalize_responses(df, "k", "t", "req").collect()}
    assert got == {(1, "Santé", "Q1"), (1, "Eau", "Q2"), (1, "Eau", "Q3"), (2, "A", "Q4")}  # a questions list is a flat list


def test_balanced_object_against_plain_loop(spark):
    import random

    from quarry.operators.survey import balanced_object
    rng = random.Random(7)
    parts = ["{", "}", '"', "\\", '"a{b"', '\\"', ",", "x", "é", "\U0001F600", "[", "]", ":", " ", '{"k": "v}"}', '{"a": {"b": 1}}']

    def plain(t):
        best, held, quoted, escaped = "", [], False, False
        for i, c in enumerate(t):
            was = quoted
            if escaped:
                escaped = False
            elif c == '"' and held:
                quoted = not quoted
            elif quoted and c == "\\":
                escaped = True
            if not was and c == "{":
                held.append(i)
            elif not was and c == "}" and held:
                a = held.pop()
                best = t[a:i + 1] if i + 1 - a > len(best) else best
        return best or None

    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 14))) for _ in range(600)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r["i"]: r["o"] for r in df.select("i", balanced_object(F.col("t")).alias("o")).collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) if t else None for t in texts]


def test_damaged_record_and_empty_aliases(spark):
    from quarry.operators.survey import normalize_responses
    text = ('note {"x": [ broken {"category_name": "", "title": "Eau", "questions": [{"question_text": "", "label": "Puits ?", "type": "", '
            '"options": [], "choices": ["oui", "non"]}]} and more text without an end {')
    df = spark.createDataFrame([("r", text, ["A"])], "id string, text string, req array<string>")
    row = normalize_responses(df, "id", "text", "req").first()
    assert (row["category_name"], row["question_text"], row["question_type"]) == ("A", "Puits ?", "text")
    assert [a["answer_text"] for a in row["expected_answers"]] == ["oui", "non"]


def test_names_of_a_common_trigram_are_dealt_over_parts(spark):
    """Every name holds the term: its names meet it in many tasks, and no trigram moves that no term needs."""
    from pyspark.sql import functions as F

    from quarry.operators import geo as G
    loc = spark.range(2000).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("ADM3_PCODE"), F.lit("sea").alias("ADM3_EN"),
                                   F.lit("AFRICA").alias("ADM1_EN"), F.lit("x").alias("ADM2_EN"))
    terms = spark.createDataFrame([("africa",), ("nothing",)], "term string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
            spark.conf.set(k, v)
        found = G.term_candidates(terms, loc)
        places = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in places) == 2000 and max(r["count"] for r in places) < 1000
    assert G.term_matches(terms, loc, 5).groupBy("term").count().collect() == [("africa", 5)]
