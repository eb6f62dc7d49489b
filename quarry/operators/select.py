"""Target and variable selection.

Every score is a column expression over ``column_profile`` (one row per column), so the
data is scanned once by the profile; rankings are windows over that small table.
Rules that read free text (objectives, prompts) are expressions over a *table* of texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.profile import column_profile, value_freq

# Name fragments that mark a target column.
TARGET_PATTERNS = ["target", "cible", "objectif", "outcome", "y_", "_y"]
# Target keywords for the simple inference.
TARGET_KEYWORDS_SIMPLE = ["target", "cible", "objectif", "resultat", "outcome",
                          "score", "note", "rating", "évaluation"]
# Objective keywords for the analysis type.
PREDICT_WORDS = ["prédire", "prédiction", "forecast", "predict"]
GROUP_WORDS = ["grouper", "segmenter", "cluster", "group"]
RELATION_WORDS = ["associer", "lier", "relation", "corrélation"]


def _completeness(prof: DataFrame) -> Column:
    rows = F.col("n") + F.col("n_null")
    return F.when(rows > 0, F.col("n") / rows).otherwise(F.lit(0.0))


def target_candidates(prof: DataFrame) -> DataFrame:
    """P17 scoring: numeric columns with >= 2 distinct and >= 10 values;
    0.4 sd/(|mean|+1e-6) + 0.3 (1 - min(|skew|/3, 1)) + 0.3 completeness, ranked."""
    score = (F.lit(0.4) * F.col("sd") / (F.abs(F.col("mean")) + 1e-6)
             + F.lit(0.3) * (1 - F.least(F.abs(F.coalesce(F.col("skew"), F.lit(0.0))) / 3, F.lit(1.0)))
             + F.lit(0.3) * _completeness(prof))
    w = Window.orderBy(F.col("score").desc(), F.col("ordinal"))
    return (prof.filter((F.col("kind") == "numeric") & (F.col("n_distinct") >= 2) & (F.col("n") >= 10))
            .select("column", "ordinal", score.alias("score"))
            .withColumn("rank", F.row_number().over(w)))


def detect_target(df: DataFrame, prompt: str = "", explicit: str | None = None,
                  prof: DataFrame | None = None) -> tuple[str | None, str]:
    """Explicit -> name pattern or named in the prompt (column order) -> best score ->
    first numeric -> first column. Returns (target, method)."""
    if explicit and explicit in df.columns:
        return explicit, "explicit"
    low_prompt = prompt.lower()
    for c in df.columns:
        cl = c.lower()
        if any(k in cl for k in TARGET_PATTERNS):
            return c, "pattern"
        if cl in low_prompt:
            return c, "prompt"
    prof = prof if prof is not None else column_profile(df)
    best = target_candidates(prof).filter(F.col("rank") == 1).select("column").collect()
    if best:
        return best[0][0], "score"
    nums = [r[0] for r in prof.filter(F.col("kind") == "numeric").orderBy("ordinal").select("column").collect()]
    if nums:
        return nums[0], "first_numeric"
    return (df.columns[0] if df.columns else None), "first_column"


def key_variables(prof: DataFrame, focus: list[str] = (), n_numeric: int | None = None,
                  n_categorical: int | None = None) -> DataFrame:
    """Numeric 0.4 min(cv,3)/3 + 0.3 completeness + 0.3 [focus] (>= 2 distinct, >= 5 values);
    categorical (2..20 distinct) 0.4 (1 - u/20) + 0.4 completeness + 0.3 [focus]; ranked, and cut
    where a number is given.
    (column, kind, ordinal, score, rank)."""
    focus_b = F.col("column").isin(list(focus)) if focus else F.lit(False)
    bonus = F.when(focus_b, 0.3).otherwise(0.0)
    cv = F.col("sd") / (F.abs(F.col("mean")) + 1e-6)
    num = (prof.filter((F.col("kind") == "numeric") & (F.col("n_distinct") >= 2) & (F.col("n") >= 5))
           .select("column", "kind", "ordinal",
                   (F.lit(0.4) * F.least(cv, F.lit(3.0)) / 3 + F.lit(0.3) * _completeness(prof) + bonus)
                   .alias("score")))
    cat = (prof.filter((F.col("kind") == "categorical") & F.col("n_distinct").between(2, 20))
           .select("column", "kind", "ordinal",
                   (F.lit(0.4) * (1 - F.col("n_distinct") / 20.0) + F.lit(0.4) * _completeness(prof) + bonus)
                   .alias("score")))
    w = Window.partitionBy("kind").orderBy(F.col("score").desc(), F.col("ordinal"))
    both = num.unionByName(cat).withColumn("rank", F.row_number().over(w))
    for kind, most in (("numeric", n_numeric), ("categorical", n_categorical)):
        if most is not None:
            both = both.filter((F.col("kind") != kind) | (F.col("rank") <= most))
    return both


def selected_variables(prof: DataFrame, focus: list[str] = (), target: str | None = None) -> dict:
    """P21 as the dict the downstream operators read (small)."""
    kv = key_variables(prof, focus).orderBy("kind", "rank").collect()
    nums = [r["column"] for r in kv if r["kind"] == "numeric"]
    cats = [r["column"] for r in kv if r["kind"] == "categorical"]
    allp = prof.orderBy("ordinal").select("column", "kind").collect()
    if not nums:
        nums = [r[0] for r in allp if r[1] == "numeric"]
    if not cats:
        cats = [r[0] for r in allp if r[1] == "categorical"]
    tgt = target if target else (nums[0] if nums else (allp[0][0] if allp else None))
    return {"target": tgt, "numeric_analysis": nums, "categorical_analysis": cats,
            "grouping_candidates": cats, "correlation_vars": nums}


def clustering_variables(df: DataFrame, prof: DataFrame, cols: list[str] | None = None,
                         top: int | None = None) -> DataFrame:
    """K1: filters (>= 10 values, var >= 0.001, binary with max share <= 95%, not
    (distinct < 3 and var < 0.1)) and score .35 var_score + .25 completeness
    + .20 min(u/15, .5) + .10 balance + .10 (1 - min(|skew|/6, .3)); ranked, the first ``top`` if set."""
    p = prof.filter(F.col("kind") == "numeric")
    if cols is not None:
        p = p.filter(F.col("column").isin(list(cols)))
    binaries = [r[0] for r in p.filter(F.col("n_distinct") == 2).select("column").collect()]
    if binaries:
        vf = value_freq(df, binaries, "double")
        share = (vf.groupBy("column").agg((F.max("n") / F.sum("n")).alias("p_max")))
        p = p.join(F.broadcast(share), "column", "left")
    else:
        p = p.withColumn("p_max", F.lit(None).cast("double"))
    var_score = F.when(F.abs(F.col("mean")) > 1e-6, F.least(F.sqrt(F.col("var")) / F.abs(F.col("mean")), F.lit(1.0))) \
        .otherwise(F.least(F.col("var"), F.lit(1.0)))
    balance = F.when(F.col("n_distinct") == 2, 1 - F.abs(F.col("p_max") - 0.5) * 2).otherwise(F.lit(1.0))
    skew_pen = 1 - F.least(F.abs(F.when(F.col("n") > 2, F.coalesce(F.col("skew"), F.lit(0.0)))
                                 .otherwise(F.lit(0.0))) / 6.0, F.lit(0.3))
    score = (var_score * 0.35 + _completeness(p) * 0.25 + F.least(F.col("n_distinct") / 15.0, F.lit(0.5)) * 0.20
             + balance * 0.10 + skew_pen * 0.10)
    ok = ((F.col("n") >= 10) & (F.col("var") >= 0.001)
          & ~((F.col("n_distinct") == 2) & (F.col("p_max") > 0.95))
          & ~((F.col("n_distinct") < 3) & (F.col("var") < 0.1)))
    w = Window.orderBy(F.col("score").desc(), F.col("ordinal"))
    out = p.filter(ok).select("column", "ordinal", score.alias("score")).withColumn("rank", F.row_number().over(w))
    return out if top is None else out.filter(F.col("rank") <= top)


def interaction_candidates(prof: DataFrame, cols: list[str] | None = None, pool: int | None = None,
                           top: int | None = None) -> DataFrame:
    """Numeric columns unique after stripping [^a-z0-9], >= 20 values, sd >= 0.01;
    the first ``pool`` of those; ranked by var * completeness, the ``top`` of them (all unless set).
    (column, ordinal, score, rank)"""
    p = prof.filter(F.col("kind") == "numeric").orderBy("ordinal").select(
        "column", "ordinal", "n", "n_null", "sd", "var").collect()
    seen, keep = set(), []
    for r in p:
        if cols is not None and r["column"] not in cols:
            continue
        base = re.sub(r"[^a-z0-9]", "", r["column"].lower())
        if base in seen or r["n"] < 20 or r["sd"] is None or r["sd"] < 0.01:
            continue
        seen.add(base)
        keep.append(r["column"])
    keep = keep[:pool]
    cand = prof.filter(F.col("column").isin(keep))
    score = F.when(F.col("var") > 0, F.col("var") * _completeness(cand)).otherwise(F.lit(0.0))
    w = Window.orderBy(F.col("score").desc(), F.col("ordinal"))
    out = cand.select("column", "ordinal", score.alias("score")).withColumn("rank", F.row_number().over(w))
    return out if top is None else out.filter(F.col("rank") <= top)


def _any_contains(text: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def analysis_type(objective: Column, n_numeric: int) -> Column:
    """P19 over a column of objective texts."""
    low = F.lower(objective)
    return (F.when(_any_contains(low, PREDICT_WORDS),
                   F.lit("regression" if n_numeric >= 5 else "classification"))
            .when(_any_contains(low, GROUP_WORDS), F.lit("clustering"))
            .when(_any_contains(low, RELATION_WORDS), F.lit("correlation"))
            .otherwise(F.lit("descriptive")))


def focus_variables(prompt: Column, columns: list[str], k: int = 5) -> Column:
    """P20: the columns named (substring, case-insensitive) in the prompt, in column order, first k."""
    low = F.lower(prompt)
    hits = F.array(*[F.when(low.contains(c.lower()), F.lit(c)) for c in columns])
    return F.slice(F.filter(hits, lambda x: x.isNotNull()), 1, k)


def infer_target_simple(prompt: Column, columns: list[str], numeric: list[str]) -> Column:
    """Keyword in a column name -> column named in the objective -> first numeric -> first column."""
    for c in columns:
        if any(k in c.lower() for k in TARGET_KEYWORDS_SIMPLE):
            return F.lit(c)
    low = F.lower(prompt)
    expr = None
    for c in columns:
        cond = low.contains(c.lower())
        expr = F.when(cond, F.lit(c)) if expr is None else expr.when(cond, F.lit(c))
    fallback = F.lit(numeric[0] if numeric else (columns[0] if columns else "unknown"))
    return expr.otherwise(fallback) if expr is not None else fallback


def context_rules(texts: DataFrame, text_col: str, table: DataFrame) -> DataFrame:
    """P18 + P19 + P20 re-aimed as a table job: for every objective text, the analysis type,
    the inferred target and the focus variables of ``table``'s schema."""
    from quarry.operators.schema import numeric_columns
    cols = table.columns
    nums = numeric_columns(table)
    t = F.col(text_col)
    return texts.select("*", analysis_type(t, len(nums)).alias("analysis_type"),
                        infer_target_simple(t, cols, nums).alias("target"),
                        F.array_join(focus_variables(t, cols), ",").alias("focus"))
