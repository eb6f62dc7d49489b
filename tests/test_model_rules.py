"""M17-M19 on runs that reach every branch, against plain Python; the pipeline on numbers and strings."""

import itertools

from quarry.operators import model as M

RUNS = "model string, train_score double, val_score double, test_score double, n_train long, n_features long, overfit boolean"


def runs(spark):
    scores = [None, 0.0, 0.45, 0.55, 0.65, 0.9, 0.99, 1.0]
    rows = [(f"m{i}", tr, va, te, n, k, flag) for i, (tr, va, te, (n, k), flag) in enumerate(itertools.product(
        scores, scores, scores, [(0, 3), (50, 20), (150, 35), (250, 40), (400, 10), (600, 10)], [True, False]))]
    return rows, spark.createDataFrame(rows, RUNS)


def expect(tr, va, te, n, k, flag):
    tr, va, te = (x or 0.0 for x in (tr, va, te))
    ratio, gap = k / max(n, 1), abs(tr - va) if tr and va else 0.0
    leak_test, leak_fit = te >= 0.99, tr >= 0.99 and va >= 0.99
    h = 100 - (60 if leak_test else 35 if leak_fit else 0)
    h -= 25 if ratio > 0.3 else 15 if ratio > 0.2 else 8 if ratio > 0.15 else 0
    h -= 20 if gap > 0.2 else 10 if gap > 0.1 else 0
    h -= 25 if te < 0.5 else 15 if te < 0.6 else 8 if te < 0.7 else 0
    h -= (10 if flag else 0) + (15 if n < 100 else 8 if n < 300 else 0)
    acts = []
    if leak_test or leak_fit:
        acts.append(("perfect_score", "haute"))
    if ratio > 0.2:
        acts.append(("reduce_features", "haute" if ratio > 0.3 else "moyenne"))
    if gap > 0.1 and not (leak_test or leak_fit):
        acts.append(("regularize", "haute" if gap > 0.2 else "moyenne"))
    if te < 0.6 and not (leak_test or leak_fit):
        acts.append(("improve_performance", "moyenne"))
    if n < 300:
        acts.append(("collect_data", "moyenne"))
    if len(acts) < 2:
        acts.append(("monitor", "basse"))
    checks = 3 if leak_test or leak_fit else 4
    return max(0, h), acts, checks


def test_every_branch(spark):
    rows, df = runs(spark)
    health = {r["model"]: r["health_score"] for r in M.model_health(df).collect()}
    acts, checks = {}, {}
    for r in M.model_actions(df).collect():
        acts.setdefault(r["model"], []).append((r["rule"], r["priority"]))
    for r in M.model_checks(df).collect():
        checks[r["model"]] = checks.get(r["model"], 0) + 1
    for m, *rest in rows:
        h, a, n = expect(*rest)
        assert (health[m], sorted(acts[m]), checks[m]) == (h, sorted(a), n), (m, rest)


def test_gap_is_absolute(spark):
    df = spark.createDataFrame([("a", 0.6, 0.9, 0.75, 1000, 5, False)], RUNS)
    assert M.model_health(df).first()["health_score"] == 80
    assert M.model_confidence(df).first()["confidence"] == "faible"


def test_pipeline_on_numbers_and_strings(spark):
    from pyspark.sql import functions as F
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"),
                                 F.when(F.col("id") % 7 > 3, "x").otherwise("y").alias("kind"))
    df = df.withColumn("y", F.col("a") * 3 + F.col("b") + F.col("id") / 1000)
    num = M.run_ml_pipeline(df, "y", ["a", "b"], "id")
    f = num["folds"].first()
    assert f["metric"] == "r2" and f["folds"] == 5 and 0.99 < f["min"] <= f["mean"] <= f["max"] <= 1
    assert num["health"].count() == 6 and num["checks"].count() >= 18 and num["best"].count() == 1
    text = M.run_ml_pipeline(df, "kind", ["a", "b"], "id")
    assert text["health"].count() == 4 and text["errors"].first()["n"] > 0 and text["cross_validation"].count() > 0
    assert text["risks"].filter("risk = 'ratio'").first()["level"] == "ok"


def test_reduction_with_string_label_and_nulls(spark):
    from pyspark.sql import functions as F
    cols = [F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") * (i + 3)) % 13).cast("double").alias(f"f{i}") for i in range(110)]
    df = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, "u").otherwise("v").alias("lab"), F.col("id").cast("double").alias("num"), *cols)
    feats = [f"f{i}" for i in range(110)]
    for label, regression in (("lab", False), ("num", True)):
        kept = M.auto_reduce(df, feats, label, 100, regression=regression)
        assert len(kept) == 20 and set(kept) <= set(feats)
