"""Model pipeline (M1-M19) on Spark ML.

Rule-based parts (risks, validity, problem type, error analysis, health score, confidence,
action rules) are expressions over tables -- a predictions table or a table of model runs
-- so they are plain aggregates and run for any number of runs at once.
Splits are hash-based (deterministic, stratified in expectation per class) rather than a
per-class window, which would put the largest class into a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.profile import value_freq

# ---------------------------------------------------------------- M1 / M4 / M5


def target_profile(df: DataFrame, target: str) -> dict:
    """n, distinct, smallest and largest class of a target column, exact, from one value table."""
    vf = value_freq(df, [target]).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.min("n").alias("lo"),
                                      F.max("n").alias("hi")).first()
    return {"n": vf["n"] or 0, "distinct": vf["d"], "min_class": vf["lo"], "max_class": vf["hi"],
            "is_string": dict(df.dtypes)[target] == "string"}


def target_validity(tp: dict, min_values: int = 20, min_class: int = 5) -> tuple[bool, str]:
    """M4: >= 20 values, >= 2 distinct, and when <= 10 classes the smallest has >= 5."""
    if tp["n"] < min_values:
        return False, "too few values"
    if tp["distinct"] < 2:
        return False, "constant target"
    if tp["distinct"] <= 10 and tp["min_class"] is not None and tp["min_class"] < min_class:
        return False, "class too small"
    return True, "ok"


def problem_type(tp: dict | None) -> str:
    """M5: none -> clustering; string -> classification; <= 2 binary; <= 10 multiclass;
    distinct / n < 0.05 classification; else regression."""
    if tp is None:
        return "clustering"
    if tp["is_string"]:
        return "classification"
    if tp["distinct"] <= 2:
        return "binary_classification"
    if tp["distinct"] <= 10:
        return "multiclass_classification"
    if tp["n"] and tp["distinct"] / tp["n"] < 0.05:
        return "classification"
    return "regression"


def overfitting_risks(prof: DataFrame, target: str, features: list[str], rows: int,
                      class_sizes: tuple[int, int] | None) -> DataFrame:
    """M1: risk rows from the column profile: features/rows ratio (> 1 high, > 0.2 warn),
    target among features, constant feature columns, class imbalance (min/max < 0.1)."""
    spark = prof.sparkSession
    ratio = len(features) / rows if rows else float("inf")
    base = [("ratio", "high" if ratio > 1 else "warning" if ratio > 0.2 else "ok", float(ratio), None)]
    if target in features:
        base.append(("target_in_features", "high", None, target))
    if class_sizes and class_sizes[1]:
        imb = class_sizes[0] / class_sizes[1]
        base.append(("class_imbalance", "warning" if imb < 0.1 else "ok", float(imb), None))
    t = spark.createDataFrame(base, "risk string, level string, value double, column string")
    const = (prof.filter(F.col("column").isin(features) & (F.col("n_distinct") <= 1))
             .select(F.lit("constant_column").alias("risk"), F.lit("warning").alias("level"),
                     F.lit(None).cast("double").alias("value"), F.col("column")))
    return t.unionByName(const)


# ---------------------------------------------------------------- M3


def hash_split(df: DataFrame, key: str, seed: int = 42, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """M3 split: u = hash(key, seed) in [0, 1); train < 0.6 <= val < 0.8 <= test."""
    u = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(seed)), F.lit(2147483648)) / F.lit(float(0x80000000))
    return df.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def class_ranks(df: DataFrame, key: str, label: str | None, seed: int) -> DataFrame:
    """The rows with __rank, their place (from 1) among their class's rows in the order of a hash of the key, and __n, the
    class's rows; one class without a label. Ranks are counts over 4,096 hash cells per class plus a rank
    inside the cell: no window holds a whole class. Null labels are a class of their own."""
    rows, cells = _hash_cells(df, key, label, seed)
    if _few_classes(df, label):  # FEW_CLASSES x 4,096 cells at most: the rows move once, for the window
        cells = F.broadcast(cells)
    return (rows.join(cells.drop("__in"), F.col("__c").eqNullSafe(F.col("c2")) & (F.col("__cell") == F.col("cell2")))
            .withColumn("__rank", _rank(key)).drop("__h", "__cell", "__c", "c2", "cell2", "__before"))


#: Classes whose hash cells are broadcast, and rows of a table that is split by ranking all of them.
FEW_CLASSES, SPLIT_ROWS = 64, 200_000


def _few_classes(df: DataFrame, label: str | None) -> bool:
    return not label or df.select(F.col(f"`{label}`")).distinct().limit(FEW_CLASSES + 1).count() <= FEW_CLASSES


def _hash_cells(df: DataFrame, key: str, label: str | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the hash of the key, its cell and their class; and per class and cell (c2, cell2) __in, its rows,
    __before, the class's rows in the cells before, and __n, the class's rows."""
    text = F.md5(F.concat_ws("|", F.col(f"`{key}`").cast("string"), F.lit(str(seed))))
    rows = (df.withColumn("__h", F.unhex(text)).withColumn("__cell", F.substring(text, 1, 3))  # bytes sort as their hex digits do
            .withColumn("__c", F.col(f"`{label}`") if label else F.lit(0)))
    cells = rows.groupBy("__c", "__cell").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("__c").orderBy("__cell")
    return rows, cells.select(F.col("__c").alias("c2"), F.col("__cell").alias("cell2"), F.col("n").alias("__in"),
                              (F.sum("n").over(upto) - F.col("n")).alias("__before"), F.sum("n").over(Window.partitionBy("__c")).alias("__n"))


def _rank(key: str) -> Column:
    return F.col("__before") + F.row_number().over(Window.partitionBy("__c", "__cell").orderBy("__h", F.col(f"`{key}`")))


def stratified_split(df: DataFrame, key: str, label: str, seed: int = 42, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """M3 for classes: each class's rows in the order of a hash of the key, cut at 60 % and 80 %, so a class of
    five rows or more is in every split.

    Beyond SPLIT_ROWS rows: a cut falls in one hash cell of a class. All other cells lie in one split with all their rows, which stay where they are:
    only the rows of the at most two cut cells of each class are ranked."""
    def part(rank: Column) -> Column:
        at = (rank - 0.5) / F.col("__n")
        return F.when(at < train, "train").when(at < train + val, "val").otherwise("test")

    if df.count() <= SPLIT_ROWS or not _few_classes(df, label):
        return class_ranks(df, key, label, seed).withColumn("split", part(F.col("__rank"))).drop("__rank", "__n")
    rows, cells = _hash_cells(df, key, label, seed)
    first, last = part(F.col("__before") + 1), part(F.col("__before") + F.col("__in"))
    cells = F.broadcast(cells.withColumn("split", F.when(first == last, first)).drop("__in"))
    dealt = rows.join(cells, F.col("__c").eqNullSafe(F.col("c2")) & (F.col("__cell") == F.col("cell2")))
    cut = dealt.filter(F.col("split").isNull()).withColumn("split", part(_rank(key)))
    return dealt.filter(F.col("split").isNotNull()).unionByName(cut).select(*[F.col(f"`{c}`") for c in df.columns], "split")


def _train_sizes(df: DataFrame, label: str, train: float = 0.6) -> DataFrame:
    """(__wl, __wn): each class and its train rows in ``stratified_split``, which follow from the class's size:
    the ranks r with (r - 0.5) / n < ``train``."""
    n, at = F.col("__n"), F.floor(F.col("__n") * train + 0.5)
    rows = F.when((at + 0.5) / n < train, at + 1).when((at - 0.5) / n < train, at).otherwise(at - 1)
    return (df.groupBy(F.col(f"`{label}`").alias("__wl")).agg(F.count(F.lit(1)).alias("__n"))
            .select("__wl", rows.cast("long").alias("__wn")))


def folds_of(df: DataFrame, key: str, label: str | None, folds: int = 5, seed: int = 43, name: str = "fold") -> DataFrame:
    """A fold from 0 for every row, dealt in turn by the rank inside its class (all rows are one class without a
    label), so folds differ by one row of a class at most and none misses a class of ``folds`` rows or more."""
    return (class_ranks(df, key, label, seed).withColumn(name, F.pmod(F.col("__rank") - 1, F.lit(folds)).cast("int"))
            .drop("__rank", "__n"))


# ---------------------------------------------------------------- M13 / M14


def classification_errors(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                          by: list[str] = ()) -> DataFrame:
    """M13 (classification): error count / rate per group."""
    wrong = (F.col(label) != F.col(prediction)).cast("int")
    return pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(wrong).cast("long").alias("errors"),
                                 F.avg(wrong.cast("double")).alias("error_rate"))


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    """M13 / M6 confusion matrix in long form."""
    return pred.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))


def per_class_accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       by: list[str] = ()) -> DataFrame:
    """M13 per-class accuracy (recall of each class)."""
    return pred.groupBy(*by, F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def residual_stats(pred: DataFrame, y: str = "y", y_hat: str = "y_hat", by: list[str] = ()) -> DataFrame:
    """M13 (regression): residual mean / sd / min / max."""
    r = F.col(y) - F.col(y_hat)
    return pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("residual_mean"),
                                 F.stddev_samp(r).alias("residual_sd"), F.min(r).alias("residual_min"),
                                 F.max(r).alias("residual_max"))


def split_metrics(pred: DataFrame, model: str = "model", label: str = "label", prediction: str = "prediction",
                  split: str = "split", n_features: int = 10) -> DataFrame:
    """Per model: accuracy on train / val / test, train size and the overfit flag -- the model-runs table."""
    ok = (F.col(label) == F.col(prediction)).cast("double")
    return pred.groupBy(model).agg(
        F.avg(F.when(F.col(split) == "train", ok)).alias("train_score"),
        F.avg(F.when(F.col(split) == "val", ok)).alias("val_score"),
        F.avg(F.when(F.col(split) == "test", ok)).alias("test_score"),
        F.count_if(F.col(split) == "train").alias("n_train")) \
        .withColumn("n_features", F.lit(n_features).cast("long")) \
        .withColumn("overfit", (F.col("n_features") > F.col("n_train")) | (_score("val_score") == 1.0))


def best_model(runs: DataFrame, metric: str = "val_score") -> DataFrame:
    """Best run by the validation metric (ties by name); exact 1.0 flags a leak. The metric's
    value also leaves as rank_score."""
    w = Window.orderBy(F.col(metric).desc(), F.col("model"))
    return (runs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") == 1)
            .withColumn("leak_warning", F.col(metric) >= 1.0).withColumn("rank_score", F.col(metric)).drop("rank"))


# ---------------------------------------------------------------- M17 / M18 / M19
# The penalties, thresholds and levels below are part of the rules' definition.


def _score(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def _run_columns(runs: DataFrame) -> dict[str, Column]:
    """The quantities that the rules look at. A missing score counts as 0; the gap between train and
    validation is absolute, and 0 where either is missing or 0. ``overfit`` is the pipeline's own flag:
    the pre-train risk is high or the validation score is perfect."""
    tr, va, te = _score("train_score"), _score("val_score"), _score("test_score")
    flag = F.col("overfit") if "overfit" in runs.columns else F.lit(False)
    leak_test, leak_fit = te >= 0.99, (tr >= 0.99) & (va >= 0.99)
    return {"tr": tr, "va": va, "te": te, "ratio": F.col("n_features") / F.greatest(F.col("n_train"), F.lit(1)),
            "gap": F.when((tr != 0) & (va != 0), F.abs(tr - va)).otherwise(0.0),
            "overfit": F.coalesce(flag, F.lit(False)), "leak_test": leak_test, "leak_fit": leak_fit, "perfect": leak_test | leak_fit}


def model_health(runs: DataFrame) -> DataFrame:
    """M17 health score: 100 minus penalties, clamped to 0..100; bon >= 70, modéré >= 50,
    else critique. Adds ratio and gap."""
    c = _run_columns(runs)
    te, ratio, gap = c["te"], c["ratio"], c["gap"]
    pen = (F.when(c["leak_test"], 60).when(c["leak_fit"], 35).otherwise(0)
           + F.when(ratio > 0.3, 25).when(ratio > 0.2, 15).when(ratio > 0.15, 8).otherwise(0)
           + F.when(gap > 0.2, 20).when(gap > 0.1, 10).otherwise(0)
           + F.when(te < 0.5, 25).when(te < 0.6, 15).when(te < 0.7, 8).otherwise(0)
           + F.when(c["overfit"], 10).otherwise(0)
           + F.when(F.col("n_train") < 100, 15).when(F.col("n_train") < 300, 8).otherwise(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - pen))
    return (runs.withColumn("ratio", ratio).withColumn("gap", gap)
            .withColumn("health_score", score.cast("long"))
            .withColumn("health_status", F.when(F.col("health_score") >= 70, "bon")
                        .when(F.col("health_score") >= 50, "modéré").otherwise("critique")))


def model_checks(runs: DataFrame) -> DataFrame:
    """M17 check rows (model, check, status, value): features per row, fit against validation, test
    performance (only where no perfect score has spoken already), and training rows."""
    c = _run_columns(runs)
    te, ratio, gap = c["te"], c["ratio"], c["gap"]
    n = F.col("n_train").cast("double")
    row = lambda name, status, value: F.struct(F.lit(name).alias("check"), status.alias("status"), value.cast("double").alias("value"))
    level = lambda bad, odd: F.when(bad, "error").when(odd, "warning").otherwise("ok")
    fit = (F.when(c["leak_test"], row("perfect_test", F.lit("error"), te))
           .when(c["leak_fit"], row("perfect_fit", F.lit("error"), te))
           .otherwise(row("train_val_gap", level(gap > 0.15, gap > 0.08), gap)))
    test = F.when(~c["perfect"], row("test_score", level(te < 0.5, te < 0.7), te))
    checks = F.array(row("feature_ratio", level(ratio > 0.3, ratio > 0.2), ratio), fit, test,
                     row("train_rows", level(n < 200, n < 500), n))
    return (runs.select("model", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("r"))
            .select("model", "r.check", "r.status", "r.value"))


def model_confidence(runs: DataFrame) -> DataFrame:
    """M18 confidence level (first match) and ratio status."""
    c = _run_columns(runs)
    te, ratio = c["te"], c["ratio"]
    conf = (F.when(c["perfect"], "faible").when(c["gap"] > 0.15, "faible").when(ratio > 0.3, "faible").when(ratio > 0.2, "modéré")
            .when(te < 0.5, "faible").when(te < 0.7, "modéré").otherwise("élevé"))
    rstat = (F.when(ratio > 0.3, "critique").when(ratio > 0.2, "élevé").when(ratio > 0.1, "modéré")
             .otherwise("bon"))
    return runs.withColumn("confidence", conf).withColumn("ratio_status", rstat)


def model_actions(runs: DataFrame) -> DataFrame:
    """M19 action rules as rows (model, rule, priority); a default rule when fewer than two fire."""
    c = _run_columns(runs)
    ratio, gap, te = c["ratio"], c["gap"], c["te"]
    rules = [
        ("perfect_score", c["perfect"], F.lit("haute")),
        ("reduce_features", ratio > 0.2, F.when(ratio > 0.3, "haute").otherwise("moyenne")),
        ("regularize", (gap > 0.1) & ~c["perfect"], F.when(gap > 0.2, "haute").otherwise("moyenne")),
        ("improve_performance", (te < 0.6) & ~c["perfect"], F.lit("moyenne")),
        ("collect_data", F.col("n_train") < 300, F.lit("moyenne")),
    ]
    arr = F.filter(F.array(*[F.when(cond, F.struct(F.lit(name).alias("rule"), prio.alias("priority")))
                             for name, cond, prio in rules]), lambda x: x.isNotNull())
    with_default = F.when(F.size(arr) < 2, F.concat(arr, F.array(F.struct(F.lit("monitor").alias("rule"),
                                                                          F.lit("basse").alias("priority")))))\
        .otherwise(arr)
    return runs.select("model", F.explode(with_default).alias("r")).select("model", "r.rule", "r.priority")


# ---------------------------------------------------------------- M2 / M6 - M12 / M15 / M16


def auto_reduce(df: DataFrame, features: list[str], label: str, rows: int, var_threshold: float = 0.01,
                most: int = 50, regression: bool = False) -> list[str]:
    """M2: with more than 100 features or more features than rows, the features of some variance, then
    the k best by F (k = min(``most``, rows / 5)): ANOVA over the classes of any label type, or the
    correlation's F for a number. Nulls count as the column's median. Returns the kept names in order."""
    if not (len(features) > 100 or len(features) > rows):
        return features
    from pyspark.ml.feature import Imputer, StringIndexer, UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler
    rows_ = df.filter(F.col(f"`{label}`").isNotNull())
    if regression:
        y = rows_.withColumn("__y", F.col(f"`{label}`").cast("double"))
    else:
        y = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(rows_).transform(rows_)
    y = y.select("__y", *[F.col(f"`{c}`").cast("double").alias(f"__x{i}") for i, c in enumerate(features)])
    cols = [f"__x{i}" for i in range(len(features))]
    lacking = y.agg(*[F.max(F.col(c).isNull() | F.isnan(c)).alias(c) for c in cols]).first().asDict()
    filled = [c for c in cols if lacking[c]]  # medians of the others would fill nothing
    if filled:
        y = Imputer(strategy="median", inputCols=filled, outputCols=filled).fit(y).transform(y)
    va = VectorAssembler(inputCols=cols, outputCol="__f").transform(y)
    if not regression:
        return _best_by_anova(va, features, var_threshold, max(1, min(most, rows // 5)))
    vt = VarianceThresholdSelector(varianceThreshold=var_threshold, featuresCol="__f", outputCol="__v").fit(va)
    kept = [features[i] for i in vt.selectedFeatures]
    k = max(1, min(most, rows // 5))
    if len(kept) <= k:
        return kept
    sel = UnivariateFeatureSelector(featuresCol="__v", outputCol="__s", labelCol="__y", selectionMode="numTopFeatures")
    sel.setFeatureType("continuous").setLabelType("continuous" if regression else "categorical").setSelectionThreshold(k)
    return [kept[i] for i in sorted(sel.fit(vt.transform(va)).selectedFeatures)]


def _best_by_anova(va: DataFrame, features: list[str], var_threshold: float, k: int) -> list[str]:
    """The features whose sample variance exceeds the threshold, of them the ``k`` of the least p-value of the ANOVA F over
    __y (ties: the first), in order. One pass: count, mean and variance of the vector __f per class, a row a class."""
    import numpy as np
    from pyspark.ml.stat import Summarizer

    from quarry.functions.stats import f_upper_p
    per = [r["s"] for r in va.groupBy("__y").agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("__f")).alias("s"))
           .orderBy("__y").collect()]
    n = np.array([r["count"] for r in per], float)[:, None]
    mean, var = (np.stack([r[m].toArray() for r in per]) for m in ("mean", "variance"))
    total, classes = n.sum(), len(per)
    within = (np.maximum(n - 1, 0) * var).sum(axis=0)
    between = (n * (mean - (n * mean).sum(axis=0) / total) ** 2).sum(axis=0)
    kept = [i for i in range(len(features)) if total > 1 and (within[i] + between[i]) / (total - 1) > var_threshold]
    if len(kept) <= k:
        return [features[i] for i in kept]
    with np.errstate(divide="ignore", invalid="ignore"):
        f = (between / (classes - 1)) / (within / (total - classes))
    upper = f_upper_p(np.where(np.isinf(f), np.nan, f), classes - 1, total - classes)  # no p-value, hence last, where all rows of a class are equal
    p = 1.0 - (1.0 - upper)  # to the precision of a distribution function near one, as Spark's selector takes it
    return [features[i] for i in sorted(sorted(kept, key=lambda i: (np.isnan(p[i]), p[i]))[:k])]


def classification_metrics(pred: DataFrame, label: str = "__y", prediction: str = "prediction",
                           split: str = "split", count: str | None = None) -> dict:
    """accuracy and weighted precision / recall / F1 per split from one confusion aggregate
    (splits x classes^2 rows), the definitions of Spark's MulticlassClassificationEvaluator. ``count``: the column that
    holds how many rows a row stands for."""
    rows = pred.groupBy(split, label, prediction).agg((F.sum(count) if count else F.count(F.lit(1))).cast("long").alias("n")).collect()
    out = {}
    for sp in {r[split] for r in rows}:
        cells = [(r[label], r[prediction], r["n"]) for r in rows if r[split] == sp]
        n = sum(c for _, _, c in cells)
        classes = {a for a, _, _ in cells} | {b for _, b, _ in cells}
        actual = {k: sum(c for a, _, c in cells if a == k) for k in classes}
        predicted = {k: sum(c for _, b, c in cells if b == k) for k in classes}
        tp = {k: sum(c for a, b, c in cells if a == k and b == k) for k in classes}
        prec = {k: (tp[k] / predicted[k]) if predicted[k] else 0.0 for k in classes}
        rec = {k: (tp[k] / actual[k]) if actual[k] else 0.0 for k in classes}
        f1 = {k: (2 * prec[k] * rec[k] / (prec[k] + rec[k])) if (prec[k] + rec[k]) else 0.0 for k in classes}
        w = {k: actual[k] / n for k in classes}
        out[sp] = {"accuracy": sum(tp.values()) / n, "precision": sum(w[k] * prec[k] for k in classes),
                   "recall": sum(w[k] * rec[k] for k in classes), "f1": sum(w[k] * f1[k] for k in classes)}
    return out


def regression_metrics(pred: DataFrame, label: str = "__y", prediction: str = "prediction",
                       split: str = "split") -> dict:
    """rmse / mae / r2 per split from one aggregate (RegressionEvaluator definitions)."""
    e = F.col(prediction) - F.col(label)
    rows = pred.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"),
                                   F.sum(F.abs(e)).alias("sae"), F.avg(label).alias("ym")).collect()
    means = {r[split]: r["ym"] for r in rows}
    m = F.lit(None).cast("double")
    for sp, v in means.items():
        m = F.when(F.col(split) == sp, F.lit(v)).otherwise(m)
    sst = {r[split]: r["sst"] for r in pred.groupBy(split).agg(
        F.sum((F.col(label) - m) * (F.col(label) - m)).alias("sst")).collect()}
    import math
    return {r[split]: {"rmse": math.sqrt(r["sse"] / r["n"]), "mae": r["sae"] / r["n"],
                       "r2": (1 - r["sse"] / sst[r[split]]) if sst[r[split]] else float("nan")} for r in rows}


def _prep_pipeline(features: list[str]):
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    imp = Imputer(strategy="median", inputCols=features, outputCols=[f"{c}__i" for c in features])
    va = VectorAssembler(inputCols=[f"{c}__i" for c in features], outputCol="__raw")
    sc = StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True)
    return [imp, va, sc]


def _lacking(df: DataFrame, features: list[str]) -> list[str]:
    """The features with a null or NaN in any row, from one pass."""
    got = df.agg(*[F.max(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double"))).alias(f"g{i}") for i, c in enumerate(features)]).first()
    return [c for i, c in enumerate(features) if got[f"g{i}"]]


def _prep_stages(features: list[str], lacking: list[str]) -> list:
    """``_prep_pipeline`` that takes medians only of the columns with gaps: those of the others would fill nothing."""
    imp, va, sc = _prep_pipeline(features)
    imp.setInputCols(lacking).setOutputCols([f"{c}__i" for c in lacking])
    va.setInputCols([f"{c}__i" if c in lacking else c for c in features])
    return ([imp] if lacking else []) + [va, sc]


#: M9: the reference's grids, in the order of its search (names sorted, the last varies fastest).
GRIDS = {
    "logistic_regression": {"C": [0.01, 0.1, 1.0]},
    "decision_tree": {"max_depth": [3, 5, 7], "min_samples_split": [2, 5, 10]},
    "random_forest": {"max_depth": [3, 5, 7], "n_estimators": [50, 100]},
    "linear_svm": {"C": [0.1, 1.0]},
}
REGRESSION_GRIDS = {
    "ridge": {"alpha": [0.1, 1.0, 10.0, 100.0]},
    "lasso": {"alpha": [0.001, 0.01, 0.1, 1.0]},
    "decision_tree": {"max_depth": [3, 5, 7]},
    "random_forest": {"max_depth": [3, 5, 7], "n_estimators": [50, 100]},
    "gradient_boosting": {"learning_rate": [0.01, 0.1], "max_depth": [3, 5], "n_estimators": [50, 100]},
}
SEARCH_FOLDS = 3
#: Rows of a partition when models are fitted: small tables are not dealt to more tasks than they fill.
FIT_ROWS = 20_000


#: Fits of more rows run two at a time: each fills the cores by itself, and all would share the cache.
CROWD_ROWS = 2_000_000


def _packed(df: DataFrame, rows: int) -> DataFrame:
    return df.coalesce(max(1, -(-rows // FIT_ROWS)))


def _at_once(jobs: int, rows: int) -> int:
    return max(1, min(jobs, 2) if rows > CROWD_ROWS else jobs)


def _f1(cells: list[tuple[float, float, int]], weighted: bool) -> float:
    """F1 of class 1, or of all classes weighted by their rows, from (label, prediction, n)."""
    def of(k):
        hit = sum(n for y, p, n in cells if y == p == k)
        both = sum(n for y, p, n in cells if y == k) + sum(n for y, p, n in cells if p == k)
        return 2 * hit / both if both else 0.0
    if not weighted:
        return of(1.0)
    total = sum(n for _, _, n in cells)
    return sum(of(k) * sum(n for y, _, n in cells if y == k) for k in {y for y, _, _ in cells}) / total if total else 0.0


def _points(grid: dict) -> list[dict]:
    """All points of a grid in the order of the search: names in order, the last varies fastest."""
    import itertools
    return [dict(zip(grid, vs)) for vs in itertools.product(*grid.values())]


def _set(name: str, est, point: dict, n: int, sd: float):
    """The estimator at a point, for a fit on ``n`` rows whose label has the standard deviation ``sd``. Spark's
    penalties are per row, its ridge's also per standard deviation of the label."""
    if name == "linear_svm":
        from quarry.operators.margin import LinearMargin
        return LinearMargin(est.n_classes, point["C"])
    param = {"C": lambda v: (est.regParam, 1.0 / (v * n)), "alpha": lambda v: (est.regParam, v * sd / n if name == "ridge" else v),
             "max_depth": lambda v: (est.maxDepth, v), "min_samples_split": lambda v: (est.minInstancesPerNode, -(-v // 2)),
             "n_estimators": lambda v: (est.maxIter if name == "gradient_boosting" else est.numTrees, v),
             "learning_rate": lambda v: (est.stepSize, v)}
    return est.copy(dict(param[p](v) for p, v in point.items()))


#: What one fit covers: the values of these settings are read off the model grown to the largest of them.
NESTED = {"decision_tree": ["max_depth"], "random_forest": ["max_depth", "n_estimators"], "gradient_boosting": ["n_estimators"]}


def grid_search(rows: DataFrame, key: str, models: dict, grids: dict, regression: bool, seed: int = 42) -> dict:
    """M9: every point of every model's grid scored on each of three folds, fitted on the other two. ``rows``
    are prepared train rows (key, features, __y, __w). Score: F1 of class 1 for two classes, weighted F1 for
    more, the negative mean squared error for a number. Folds are stratified by class.

    Points share fits where models are nested: a tree cut at a depth, the first trees of a forest, the first rounds
    of a boosted model; all linear machines are solved side by side. Boosted models and classifying trees and forests
    of many rows grow on their cells (cells.py), with edges from all of ``rows``. Returns per model
    {"est": the estimator with the best point (ties: the first) for a fit on all of ``rows``, "best": its text,
    "points": (text, mean, population sd) of all}; a model without a grid, and every one where a fold
    is empty, keeps its own parameters."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator

    from quarry.operators import cells, grow, margin
    from quarry.operators.staged import staged_scores
    own = {name: {"est": est, "best": None, "points": []} for name, est in models.items()}
    rows = folds_of(rows, key, None if regression else "__y", SEARCH_FOLDS, seed + 2, "__fold").persist()
    per = {r["__fold"]: r for r in rows.groupBy("__fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__y").alias("s"), F.sum(F.col("__y") * F.col("__y")).alias("q"),
        F.max("__y").alias("hi")).collect()}
    if len(per) < SEARCH_FOLDS:
        rows.unpersist()
        return own
    total = sum(r["n"] for r in per.values())
    packed = _packed(rows, total).persist()
    packed.count()
    rows.unpersist()
    small = cells.shrunk(packed, total, ["__fold"]) if regression else None
    held = _number_cells(small, "__fold")
    drawn = held is not None and total > cells.FOREST_ROWS
    lines = grow.Moments(packed, "__fold") if regression and total > cells.ROWS else None
    grown = _packed(small[1], small[2]) if small else None
    classed = cells.class_cells(packed, packed, total, ["__fold", "__y", "__w"]) if not regression else None
    weighted = max(r["hi"] for r in per.values()) > 1

    def shape(folds):
        n, s, q = (sum(per[f][c] for f in folds) for c in ("n", "s", "q"))
        return n, max(q / n - (s / n) ** 2, 0.0) ** 0.5

    if regression:
        score, sign = RegressionEvaluator(labelCol="__y", metricName="mse"), -1.0
    elif weighted:
        score, sign = MulticlassClassificationEvaluator(labelCol="__y", metricName="f1"), 1.0
    else:
        score, sign = MulticlassClassificationEvaluator(labelCol="__y", metricName="fMeasureByLabel", metricLabel=1.0), 1.0

    def one(job):
        """{point as text: score} of one fit."""
        name, f, point = job
        grid, nested = grids[name], NESTED.get(name, [])
        largest = point | {p: max(grid[p]) for p in nested}
        est = _set(name, models[name], largest, *shape([x for x in per if x != f]))
        test = packed.filter(F.col("__fold") == f)
        if name in LINES and lines:
            model = est.copy({est.weightCol: "__n"}).fit(lines.rows(rows.sparkSession, [x for x in per if x != f]))
            return {_say(name, point, grids): -lines.error([f], model.coefficients.toArray(), model.intercept)}
        if name == "gradient_boosting" and small:
            model = _on_cells(est).fit(grown.filter(F.col("__fold") != f))
            test = cells.with_bins(test, small[0]).withColumn("__n", F.lit(1.0))
        elif nested and classed:
            test = classed[1].filter(F.col("__fold") == f)
            model = cells.grown(est, classed[1].filter(F.col("__fold") != f), seed)
        else:
            model = est.fit(packed.filter(F.col("__fold") != f))
        if name == "gradient_boosting":
            errors = model.evaluateEachIteration(test, "squared")
            return {_say(name, point | {"n_estimators": v}, grids): -errors[min(v, len(errors)) - 1] for v in grid["n_estimators"]}
        if not nested:
            return {_say(name, point, grids): sign * score.evaluate(model.transform(test))}
        out: dict = {}
        counts = grid.get("n_estimators", [1])
        scored = staged_scores(test, model, grid["max_depth"], counts, **({"features": "__bins", "count": "__n"} if classed else {}))
        for d in grid["max_depth"]:
            for t in counts:
                mine = [r for r in scored if r["depth"] == d and r["trees"] == t]
                value = (-sum(r["error"] for r in mine) / max(sum(r["n"] for r in mine), 1) if regression
                         else _f1([(r["y"], r["prediction"], r["n"]) for r in mine], weighted))
                out[_say(name, point | {"max_depth": d} | ({"n_estimators": t} if "n_estimators" in grid else {}), grids)] = value
        return out

    def machines():
        """Scores of the linear machines: all folds, penalties and classes in the same passes."""
        est, cs = models["linear_svm"], grids["linear_svm"]["C"]
        x = margin.prepared(packed, fold="__fold").persist()
        problems = [(k, c, f) for f in sorted(per) for c in cs for k in est.classes()]
        solved = margin.solve(x, problems, x.select(F.size("x")).first()[0], total)
        weights = {(f, c): solved[[i for i, p in enumerate(problems) if p[1:] == (c, f)]] for f in per for c in cs}
        got = margin.predicted(x, weights).collect()
        x.unpersist()
        return {(_say("linear_svm", {"C": c}, grids), f): _f1([(r["y"], r["prediction"], r["n"]) for r in got if r["fold"] == f and r["c"] == c], weighted)
                for f in per for c in cs}

    def in_cells(whole):
        """Scores of the jobs ``whole``, each grown in a task that holds all cells; forests from the draws of one pass."""
        forest = [j for j in whole if j[0] == "random_forest"]
        forests = (grow.drawn_forests(packed, held, _set("random_forest", models["random_forest"], {p: max(v) for p, v in grids["random_forest"].items()},
                                                         total, 0.0), seed, [f for _, f, _ in forest], "__fold") if forest else {})
        depths = {name: grid["max_depth"] for name, grid in grids.items() if "max_depth" in grid}
        counts = {name: grid.get("n_estimators", [1]) for name, grid in grids.items()}
        least = {name: est.getMinInstancesPerNode() for name, est in models.items() if hasattr(est, "getMinInstancesPerNode")}
        steps = {name: est.getStepSize() for name, est in models.items() if hasattr(est, "getStepSize")}
        deep = {name: est.getMaxDepth() for name, est in models.items() if hasattr(est, "getMaxDepth")}

        def run(shared, job):
            cells_, forests_ = shared
            name, f, point = job
            rest = [p for p in cells_.parts if p != f]
            if name == "gradient_boosting":
                n, mean = cells_.of(rest)
                said = grow.boosted(cells_.bins, n, mean, point.get("learning_rate", steps[name]), point.get("max_depth", deep[name]), counts[name], least[name])
                return [({"n_estimators": t}, -cells_.error(f, told)) for t, told in said.items()]
            trees = forests_[f].tables if name == "random_forest" else [grow.number_tree(cells_, rest, max(depths[name]), least[name])]
            return [({"max_depth": d} | ({"n_estimators": t} if name == "random_forest" else {}), -cells_.error(f, told[:, 0]))
                    for d, t, told in grow._values(trees, cells_.bins.astype(float), depths[name], counts[name])]

        got = grow.in_tasks(rows.sparkSession, (held, forests), whole, run)
        return [{_say(j[0], j[2] | more, grids): v for more, v in scores_} for j, scores_ in zip(whole, got)]

    jobs = [(name, f, point) for name in models if name in grids and name != "linear_svm"
            for point in _points({p: v for p, v in grids[name].items() if p not in NESTED.get(name, [])}) for f in sorted(per)]
    jobs.sort(key=lambda j: j[0] != "gradient_boosting")  # the longest first
    whole = [j for j in jobs if held is not None and (j[0] in ("gradient_boosting", "decision_tree") or j[0] == "random_forest" and drawn)]
    jobs = [j for j in jobs if j not in whole]
    with ThreadPoolExecutor(max_workers=_at_once(8, total)) as ex:
        svm = ex.submit(machines) if "linear_svm" in models and "linear_svm" in grids else None
        done = list(ex.map(one, jobs))
        svm = svm.result() if svm else {}
    done, jobs = done + (in_cells(whole) if whole else []), jobs + whole
    packed.unpersist()
    for made in (small, classed):
        if made:
            made[1].unpersist()
    scores: dict = {}
    for (name, f, _), got in zip(jobs, done):
        for text, v in got.items():
            scores.setdefault((name, text), {})[f] = v
    for (text, f), v in svm.items():
        scores.setdefault(("linear_svm", text), {})[f] = v
    for name in models:
        if name not in grids:
            continue
        points = _points(grids[name])
        table = []
        for point in points:
            xs = list(scores[(name, _say(name, point, grids))].values())
            mean = sum(xs) / len(xs)
            table.append((_say(name, point, grids), mean, (sum((x - mean) ** 2 for x in xs) / len(xs)) ** 0.5))
        best = max(range(len(table)), key=lambda i: (table[i][1], -i))
        own[name] = {"est": _set(name, models[name], points[best], *shape(per)), "best": table[best][0], "points": table}
    return own


#: Linear models of a number: on many rows fitted from sums of products.
LINES = ("linear_regression", "ridge", "lasso")


def _number_cells(small, by: str):
    """The cells of ``cells.shrunk`` in arrays; None without, or where a task would not hold them."""
    from quarry.operators import grow
    return grow.NumberCells(small[0], small[1], by) if small and small[2] <= grow.MOST and grow.countable(small[0]) else None


def _on_cells(est):
    return est.copy({est.featuresCol: "__bins", est.weightCol: "__n"})


def _say(name: str, point: dict, grids: dict) -> str:
    return ", ".join(f"{p}={point[p]}" for p in grids[name])


_TUNED = ", best_params string, grid array<struct<params: string, score_mean: double, score_std: double>>"


def grid_table(metrics: DataFrame) -> DataFrame:
    """M9: a row for each point of each model's grid, from the metrics of a tuned training."""
    return metrics.select("model", F.explode("grid").alias("p"), "best_params").select(
        "model", "p.params", "p.score_mean", "p.score_std", (F.col("p.params") == F.col("best_params")).alias("best"))


def train_classifiers(df: DataFrame, features: list[str], label: str, key: str, seed: int = 42,
                      n_classes: int | None = None, with_predictions: bool = False, tune: bool = False):
    """M3 + M6 + M11 + M15: stratified split, balanced class weights where the smallest class has under
    0.3 of the largest's rows, imputer / scaler fitted on train only, logistic regression,
    decision tree (depth 5), random forest (100 trees, depth 5), linear SVM (margin.py; each class against the
    rest beyond two). With ``tune`` every model is trained with the best point of its grid (M9), and the
    metrics have best_params and grid. On many rows tree and forest grow on cells (cells.py). Returns (metrics table, importances table) and, if asked, each
    model's predictions (__y, prediction, split)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StringIndexer

    from quarry.operators import cells
    from quarry.operators.margin import LinearMargin
    spark = df.sparkSession
    data = stratified_split(df.filter(F.col(f"`{label}`").isNotNull()), key, label, seed)
    sizes = _train_sizes(df.filter(F.col(f"`{label}`").isNotNull()), label)
    lo, hi, k, n_train = sizes.agg(F.min("__wn"), F.max("__wn"), F.count(F.lit(1)), F.coalesce(F.sum("__wn"), F.lit(0))).first()
    if k and k > 1 and lo / hi < 0.3:  # balanced weights: every class weighs the same in all
        weights = sizes.select("__wl", (F.lit(float(n_train)) / (F.lit(float(k)) * F.col("__wn"))).alias("__w"))
        data = data.join(weights, F.col(f"`{label}`") == F.col("__wl"), "left").drop("__wl").withColumn("__w", F.coalesce("__w", F.lit(1.0)))
    else:
        data = data.withColumn("__w", F.lit(1.0))
    # only what the fits read is cached, as plain numbers: a vector a row takes three times the memory
    data = _packed(data.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*([key] if tune else []), *features, label, "__w", "split"])]), 2 * n_train).persist()
    idx = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc")
    # fitted once for all models
    prep = Pipeline(stages=[idx] + _prep_stages(features, _lacking(data, features))).fit(data.filter(F.col("split") == "train"))
    plain, data = data, prep.transform(data).select(*([key] if tune else []), "features", "__y", "__w", "split")
    train = data.filter(F.col("split") == "train")
    small = cells.class_cells(data, train, n_train, ["split", "__y", "__w"])
    models = {
        "logistic_regression": LogisticRegression(featuresCol="features", labelCol="__y", weightCol="__w",
                                                  regParam=1.0 / (0.1 * max(n_train, 1)), standardization=False),
        "decision_tree": DecisionTreeClassifier(featuresCol="features", labelCol="__y", weightCol="__w", maxDepth=5, seed=seed),
        "random_forest": RandomForestClassifier(featuresCol="features", labelCol="__y", weightCol="__w", numTrees=100, maxDepth=5,
                                                seed=seed),
    }
    models["linear_svm"] = LinearMargin(n_classes or max(k, 2))
    found = None
    if tune:
        found = grid_search(train.select(key, "features", "__y", "__w"), key, models, GRIDS, False, seed)
        models = {name: f["est"] for name, f in found.items()}
    metrics, imps = [], []
    def fit(item):
        name, est = item
        if name in ("decision_tree", "random_forest") and small:
            model = cells.grown(est, small[1].filter(F.col("split") == "train"), seed)
            return name, model, classification_metrics(model.transform(small[1]), count="__n")
        model = est.fit(train)
        return name, model, classification_metrics(model.transform(data))

    raw = stratified_split(df.filter(F.col(f"`{label}`").isNotNull()), key, label, seed)

    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=_at_once(len(models), n_train)) as ex:  # independent fits run as concurrent jobs
        fitted = list(ex.map(fit, models.items()))
    for name, model, mm in fitted:
        row = [name]
        for part in ("train", "val", "test"):
            row += [mm.get(part, {}).get(m) for m in ("accuracy", "precision", "recall", "f1")]
        metrics.append(tuple(row) + (n_train, len(features)) + ((found[name]["best"], found[name]["points"]) if tune else ()))
        imps += [(name, f, float(v)) for f, v in zip(features, _importances(model, len(features)))]
    plain.unpersist()
    if small:
        small[1].unpersist()
    cols = ["model"] + [f"{p}_{m}" for p in ("train", "val", "test") for m in ("accuracy", "precision", "recall", "f1")]
    mt = spark.createDataFrame(metrics, ", ".join(f"{c} {'string' if c == 'model' else 'double'}" for c in cols)
                               + ", n_train long, n_features long" + (_TUNED if tune else ""))
    it = spark.createDataFrame(imps, "model string, feature string, importance double")
    w = Window.partitionBy("model").orderBy(F.col("importance").desc(), F.col("feature"))
    it = it.withColumn("rank", F.row_number().over(w))
    if not with_predictions:
        return mt, it
    ready = prep.transform(raw)
    binned = cells.with_bins(ready, small[0]) if small else ready
    return mt, it, {name: model.transform(binned if small and model.getFeaturesCol() == "__bins" else ready).select("__y", "prediction", "split")
                    if hasattr(model, "getFeaturesCol") else model.transform(ready).select("__y", "prediction", "split") for name, model, _ in fitted}


def _importances(model, k: int) -> list[float]:
    """Tree importances, or mean |coefficient| per feature; normalised to sum 1."""
    import numpy as np
    if hasattr(model, "featureImportances"):
        v = np.asarray(model.featureImportances.toArray(), float)
    elif hasattr(model, "coefficientMatrix"):
        v = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        v = np.abs(model.coefficients.toArray())
    elif hasattr(model, "models"):  # one-vs-rest
        v = np.mean([np.abs(m.coefficients.toArray()) for m in model.models], axis=0)
    else:
        v = np.zeros(k)
    s = v.sum()
    return list(v / s) if s > 0 else list(v)


def train_regressors(df: DataFrame, features: list[str], label: str, key: str, seed: int = 42, tune: bool = False) -> DataFrame:
    """M7: OLS, ridge (alpha 1), lasso (alpha .1), tree, forest, GBT(100, .1, depth 3); rmse / mae / r2. With
    ``tune`` every model that has a grid is trained with its best point (M9): best_params and grid."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                       RandomForestRegressor)

    from quarry.operators import cells, grow
    spark = df.sparkSession
    data = hash_split(df.filter(F.col(f"`{label}`").isNotNull()), key, seed).withColumn("__y", F.col(f"`{label}`").cast("double"))
    total = data.count()
    data = _packed(data.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*([key] if tune else []), *features])], "__y", "split"), total).persist()
    prep = Pipeline(stages=_prep_stages(features, _lacking(data, features))).fit(data.filter(F.col("split") == "train"))  # once for all models
    plain, data = data, prep.transform(data).select(*([key] if tune else []), "features", "__y", "split")
    if total <= CROWD_ROWS:  # beyond, the plain numbers stay: a vector a row takes three times the memory
        data.persist()
    train = data.filter(F.col("split") == "train")
    n = max(train.count(), 1)
    if total <= CROWD_ROWS:
        plain.unpersist()
    models = {
        "linear_regression": LinearRegression(featuresCol="features", labelCol="__y"),
        "ridge": LinearRegression(featuresCol="features", labelCol="__y", regParam=1.0 / n, elasticNetParam=0.0),
        "lasso": LinearRegression(featuresCol="features", labelCol="__y", regParam=0.1, elasticNetParam=1.0),
        "decision_tree": DecisionTreeRegressor(featuresCol="features", labelCol="__y", maxDepth=5, seed=seed),
        "random_forest": RandomForestRegressor(featuresCol="features", labelCol="__y", numTrees=100, maxDepth=5,
                                               seed=seed),
        "gradient_boosting": GBTRegressor(featuresCol="features", labelCol="__y", maxIter=100, stepSize=0.1,
                                          maxDepth=3, seed=seed),
    }
    found = None
    if tune:
        found = grid_search(train.select(key, "features", "__y"), key, models, REGRESSION_GRIDS, True, seed)
        models = {name: f["est"] for name, f in found.items()}
    out = []
    small = cells.shrunk(data, n, ["split"], train)
    held = _number_cells(small, "split")
    lines, told = {}, {}
    if n > cells.ROWS:
        sums = grow.Moments(train, None)
        few = sums.rows(spark, sums.per)
        for name in LINES:
            model = models[name].copy({models[name].weightCol: "__n"}).fit(few)
            lines[name] = model.coefficients.toArray(), model.intercept
    if held is not None:
        tree, boost = models["decision_tree"], models["gradient_boosting"]
        depth, rounds = {"tree": tree.getMaxDepth(), "boost": boost.getMaxDepth()}, boost.getMaxIter()
        least, rate = {"tree": tree.getMinInstancesPerNode(), "boost": boost.getMinInstancesPerNode()}, boost.getStepSize()

        def grown(cells_, job):
            if job == "tree":
                return grow.Grown([grow.number_tree(cells_, ["train"], depth[job], least[job])], cells_.bins.shape[1]).values(cells_.bins.astype(float))
            return grow.boosted(cells_.bins, *cells_.of(["train"]), rate, depth[job], [rounds], least[job])[rounds]
        told["decision_tree"], told["gradient_boosting"] = grow.in_tasks(spark, held, ["tree", "boost"], grown)
        if n > cells.FOREST_ROWS:
            forest = grow.drawn_forests(train, held, models["random_forest"], seed, [None], None)[None]
            told["random_forest"] = forest.values(held.bins.astype(float))
    quick = grow.scored(data, lines, held, told, float(sums.of(sums.per)[1][-1])) if lines or told else {}

    def fit(item):
        name, est = item
        if name in quick:
            return name, quick[name]
        if name == "gradient_boosting" and small:
            model = _on_cells(est).fit(_packed(small[1].filter("split = 'train'"), small[2]))
            return name, regression_metrics(model.transform(cells.with_bins(data, small[0])))
        return name, regression_metrics(est.fit(train).transform(data))

    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=_at_once(len(models), n)) as ex:
        fitted = list(ex.map(fit, models.items()))
    if small:
        small[1].unpersist()
    for name, mm in fitted:
        row = [name]
        for part in ("train", "val", "test"):
            row += [mm.get(part, {}).get(m) for m in ("rmse", "mae", "r2")]
        out.append(tuple(row) + (n, len(features)) + ((found[name]["best"], found[name]["points"]) if tune else ()))
    data.unpersist()
    plain.unpersist()
    cols = ["model"] + [f"{p}_{m}" for p in ("train", "val", "test") for m in ("rmse", "mae", "r2")]
    return spark.createDataFrame(out, ", ".join(f"{c} {'string' if c == 'model' else 'double'}" for c in cols)
                                 + ", n_train long, n_features long" + (_TUNED if tune else ""))


def cross_validate(df: DataFrame, features: list[str], label: str, key: str, folds: int = 5, regression: bool = False,
                   seed: int = 42, estimator=None) -> DataFrame:
    """(metric, fold, n, score): the model fitted on all folds but one and scored on that one, for every fold.
    Folds are stratified by class (``folds_of``). F1 of the second class for two classes, weighted F1 for more,
    R2 for a number; logistic or linear regression unless an estimator (features, __y, __w) is given."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.regression import LinearRegression
    rows = df.filter(F.col(f"`{label}`").isNotNull()).select(*[F.col(f"`{c}`") for c in dict.fromkeys([key, *features, label])])
    n = rows.count()
    data = folds_of(rows, key, None if regression else label, folds, seed + 1, "split")
    data = data.withColumn("__w", F.lit(1.0))
    kinds = 0
    if regression:
        data = data.withColumn("__y", F.col(f"`{label}`").cast("double"))
        estimator = estimator or LinearRegression(featuresCol="features", labelCol="__y")
    else:  # indexed once, so that a fold without a class still knows it
        index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(rows)
        data, kinds = index.transform(data), len(index.labels) if n else 0
        estimator = estimator or LogisticRegression(featuresCol="features", labelCol="__y")
    packed = _packed(data.select(*[F.col(f"`{c}`") for c in features], "__y", "__w", "split"), n).persist()  # once, and only what the fits read
    sizes = {r["split"]: r["n"] for r in packed.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    stages = _prep_stages(features, _lacking(packed, features)) + [estimator]

    def one(f: int):
        model = Pipeline(stages=stages).fit(packed.filter(F.col("split") != f))
        pred = model.transform(packed.filter(F.col("split") == f))
        if regression:
            return regression_metrics(pred)[f]["r2"]
        cells = [(r["__y"], r["prediction"], r["n"]) for r in pred.groupBy("__y", "prediction").agg(F.count(F.lit(1)).alias("n")).collect()]
        return _f1(cells, kinds > 2)

    with ThreadPoolExecutor(max_workers=_at_once(folds, n)) as ex:
        scores = list(ex.map(one, sorted(sizes))) if len(sizes) > 1 else []
    packed.unpersist()
    name = "r2" if regression else "f1_weighted" if kinds > 2 else "f1"
    return df.sparkSession.createDataFrame([(name, f, sizes[f], float(s)) for f, s in zip(sorted(sizes), scores)],
                                           "metric string, fold int, n long, score double")


def fold_scores(df: DataFrame, features: list[str], label: str, key: str, folds: int = 5, regression: bool = False,
                seed: int = 42, estimator=None) -> DataFrame:
    """Mean, standard deviation (population), least and greatest score of ``cross_validate``."""
    return summed_folds(cross_validate(df, features, label, key, folds, regression, seed, estimator))


def summed_folds(scores: DataFrame) -> DataFrame:
    return scores.groupBy("metric").agg(
        F.count(F.lit(1)).cast("int").alias("folds"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"),
        F.min("score").alias("min"), F.max("score").alias("max"))


def clustering_model(vec: DataFrame, k_max: int = 5, seed: int = 42) -> DataFrame:
    """M8: k = 2..min(5, n/10) by silhouette. Each k starts where Spark's KMeans does (k-means||); the steps of all k
    are the same passes (``lloyd.refined``), as are the sizes and distances for Davies-Bouldin and Calinski-Harabasz.
    Only the vectors are cached."""
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from quarry.operators import lloyd
    vec = vec.select("features").persist()
    n = vec.count()
    ks = list(range(2, max(2, min(k_max, n // 10)) + 1))
    begin = [np.array(KMeans(k=k, seed=seed, featuresCol="features", maxIter=0).fit(vec).clusterCenters()) for k in ks]
    x = lloyd.dealt(vec.select(vector_to_array("features").alias("x")), n).persist()
    x.count()
    vec.unpersist()
    found = lloyd.refined(x, begin)
    per = lloyd.spreads(x, [c for c, _ in found])
    rows = []
    for k, (C, ssw), groups in zip(ks, found, per):
        pred = x.select(array_to_vector("x").alias("features")).withColumn("prediction", lloyd.nearest(C))
        sil = ClusteringEvaluator(featuresCol="features").evaluate(pred)
        gmean = sum(C[j] * size for j, (size, _) in groups.items()) / n
        db = float(np.mean([max((groups[i][1] + groups[j][1]) / np.linalg.norm(C[i] - C[j]) for j in groups if j != i) for i in groups]))
        ssb = sum(size * float(np.sum((C[j] - gmean) ** 2)) for j, (size, _) in groups.items())
        ch = (ssb / (k - 1)) / (ssw / (n - k)) if ssw > 0 else float("inf")
        rows.append((k, sil, db, ch, ssw, [groups[j][0] for j in sorted(groups)]))
    x.unpersist()
    t = vec.sparkSession.createDataFrame(rows, "k int, silhouette double, davies_bouldin double, "
                                               "calinski_harabasz double, inertia double, sizes array<long>")
    return t.withColumn("best", F.row_number().over(Window.orderBy(F.col("silhouette").desc(), F.col("k"))) == 1)


def permutation_importance(model, data: DataFrame, features: list[str], key: str, score: Column | None = None,
                           repeats: int = 10, seed: int = 42) -> DataFrame:
    """Mean drop of a score when one feature is permuted (``score``: an aggregate over __y and
    prediction, accuracy unless given).

    Rows are ranked once by a hash of the key (one sort, written once). A repeat's permutation is an affine
    map of the rank modulo n, so it is one equi-join that brings every feature's permuted value; a copy
    of the row for each feature, with that value in its place, is scored in the same pass."""
    import math

    from quarry.operators.prepare import row_index
    score = score if score is not None else F.avg((F.col("__y") == F.col("prediction")).cast("double"))
    base = model.transform(data).agg(score).first()[0]
    ranked = row_index(data, F.xxhash64(F.col(f"`{key}`"), F.lit(seed)), "__r").persist()
    n = ranked.count()
    drops = {f: [] for f in features}
    for r in range(repeats if n > 1 else 0):
        a = (2654435761 * (r + 1) + seed) % n | 1
        while math.gcd(a, n) != 1:
            a += 2
        b = (40503 * (r + 1) + seed) % n
        src = ranked.select(F.pmod(F.col("__r") * F.lit(a % n) + F.lit(b), F.lit(n)).alias("__r"),
                            *[F.col(f"`{f}`").alias(f"__p{i}") for i, f in enumerate(features)])
        rows = ranked.join(src, "__r").withColumn("__f", F.explode(F.array(*[F.lit(i) for i in range(len(features))])))
        for i, f in enumerate(features):
            rows = rows.withColumn(f, F.when(F.col("__f") == i, F.col(f"__p{i}")).otherwise(F.col(f"`{f}`")))
        got = model.transform(rows.drop("__r", *[f"__p{i}" for i in range(len(features))])).groupBy("__f").agg(score.alias("s"))
        for row in got.collect():
            drops[features[row["__f"]]].append(base - row["s"])
    ranked.unpersist()
    rows = [(f, float(sum(d) / len(d)) if d else 0.0) for f, d in drops.items()]
    t = data.sparkSession.createDataFrame(rows, "feature string, importance double")
    total = sum(max(v, 0.0) for _, v in rows)
    return t.withColumn("normalized", F.when(F.lit(total) > 0, F.greatest(F.col("importance"), F.lit(0.0)) / F.lit(total or 1.0)))


def run_ml_pipeline(df: DataFrame, target: str | None, features: list[str], key: str, tune: bool = True) -> dict[str, DataFrame]:
    """Pre-train risks, validity, problem type, reduction, training on each model's best grid point (unless ``tune`` is off), best model by validation F1 (R2
    for a number), cross-validation, error analysis of the best model, health, checks, confidence and
    actions. Returns the result tables."""
    spark = df.sparkSession
    out: dict[str, DataFrame] = {}
    if target is None:
        from quarry.operators.segment import standardize
        vec, _ = standardize(df, features, key)
        out["clustering"] = clustering_model(vec)
        return out
    tp = target_profile(df, target)
    ok, why = target_validity(tp)
    ptype = problem_type(tp)
    out["target"] = spark.createDataFrame([(target, tp["n"], tp["distinct"], ok, why, ptype)],
                                          "target string, n long, n_distinct long, valid boolean, reason string, "
                                          "problem_type string")
    from quarry.operators.profile import column_profile
    prof = column_profile(df.select(*features), with_quantiles=False)
    classes = (tp["min_class"], tp["max_class"]) if "classification" in ptype else None
    out["risks"] = overfitting_risks(prof, target, features, tp["n"], classes)
    if not ok:
        return out
    high = out["risks"].filter("level = 'high'").limit(1).count() > 0
    regression = ptype == "regression"
    feats = auto_reduce(df, features, target, tp["n"], regression=regression)
    if regression:
        metrics = train_regressors(df, feats, target, key, tune=tune)
        runs = metrics.select("model", F.col("train_r2").alias("train_score"), F.col("val_r2").alias("val_score"),
                              F.col("test_r2").alias("test_score"), "n_train", "n_features")
    else:
        metrics, out["importance"], pred = train_classifiers(df, feats, target, key, n_classes=tp["distinct"], with_predictions=True, tune=tune)
        runs = metrics.select("model", F.col("train_accuracy").alias("train_score"), F.col("val_accuracy").alias("val_score"),
                              F.col("test_accuracy").alias("test_score"), "n_train", "n_features")
    if tune:
        out["grid"] = grid_table(metrics)
    out["cross_validation"] = cross_validate(df, feats, target, key, regression=regression)
    out["folds"] = summed_folds(out["cross_validation"])
    rank_by = metrics.select("model", F.col("val_r2" if regression else "val_f1").alias("rank_score"))
    perfect = rank_by.agg(F.max("rank_score") == 1.0).first()[0]
    runs = runs.withColumn("overfit", F.lit(bool(high or perfect)))
    out["metrics"] = metrics
    out["best"] = best_model(runs.join(rank_by, "model"), "rank_score")
    if not regression:
        name = out["best"].first()["model"]
        val = pred[name].filter("split = 'val'")
        out["errors"] = classification_errors(val, "__y", "prediction")
        out["class_accuracy"] = per_class_accuracy(val, "__y", "prediction")
    out["health"] = model_confidence(model_health(runs))
    out["checks"] = model_checks(runs)
    out["actions"] = model_actions(runs)
    return out
