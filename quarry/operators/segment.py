"""Segmentation (K2-K18): Spark ML clustering plus cluster profiles as aggregates.

Points never leave the cluster: every per-point table (labels, 3-D coordinates) is a
DataFrame keyed by the caller's row key. Per-cluster statistics are groupBy aggregates
(k rows), joined back with a broadcast of those k rows.
Silhouette is Spark's ClusteringEvaluator (squared Euclidean, linear time), which differs
from an exact Euclidean silhouette; thresholds stay parameters.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.stats import basic_stats, central_sums, quantiles
from quarry.operators import lloyd
from quarry.session import cut_lineage

# ---------------------------------------------------------------- K2


def standardize(df: DataFrame, cols: list[str], key: str, min_rows: int = 10) -> tuple[DataFrame | None, dict]:
    """K2: median impute -> drop rows still null -> (x - mean) / sd_pop -> non-finite 0,
    assembled into a vector column ``features``. Returns (key, cols..., features), stats."""
    from pyspark.ml.feature import VectorAssembler
    zdf, stats = standardized(df, cols, key, min_rows)
    if zdf is None:
        return None, {}
    vec = VectorAssembler(inputCols=[f"z_{c}" for c in cols], outputCol="features").transform(zdf)
    return vec.drop(*[f"z_{c}" for c in cols]), stats


def standardized(df: DataFrame, cols: list[str], key: str, min_rows: int = 10) -> tuple[DataFrame | None, dict]:
    """K2 as plain columns: (key, cols..., z_cols...), stats. Medians are taken only of columns with nulls: those of the others
    would fill nothing."""
    held = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`").cast("double")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    lacking = [c for i, c in enumerate(cols) if held[f"n{i}"] < held["n"]]
    med = quantiles(df, lacking, [0.5]) if lacking else {}
    filled = df.select(key, *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(med[c][0] if c in med else None)).alias(c) for c in cols])
    filled = filled.dropna(subset=cols)
    bs = basic_stats(filled, cols)
    if bs["__rows"] < min_rows:
        return None, {}
    cs = central_sums(filled, cols, {c: bs[c]["mean"] for c in cols})
    sdp = {c: math.sqrt(cs[f"m2_{i}"] / bs[c]["n"]) if bs[c]["n"] else 0.0 for i, c in enumerate(cols)}
    z = [F.when(F.lit(sdp[c]) > 0, (F.col(c) - F.lit(bs[c]["mean"])) / F.lit(sdp[c] or 1.0)).otherwise(F.lit(0.0))
         .alias(f"z_{c}") for c in cols]
    return filled.select(key, *cols, *z), {"mean": {c: bs[c]["mean"] for c in cols}, "sd_pop": sdp}


# ---------------------------------------------------------------- K6 / K7


def rebalance(labels: DataFrame, col: str = "cluster", min_share: float = 0.05) -> DataFrame:
    """K6: clusters smaller than floor(min_share * n) are reassigned to the lowest-numbered
    cluster that is not small. The size table has k rows; the mapping is broadcast."""
    sizes = labels.groupBy(col).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    min_size = int(total * min_share)
    rows = sizes.collect()
    valid = sorted(r[col] for r in rows if r["size"] >= min_size)
    if not valid:
        return labels
    mapping = {r[col]: (valid[0] if r["size"] < min_size else r[col]) for r in rows}
    m = labels.sparkSession.createDataFrame(list(mapping.items()), f"__from int, __to int")
    return (labels.join(F.broadcast(m), labels[col] == m["__from"], "left")
            .withColumn(col, F.coalesce(F.col("__to"), F.col(col)).cast("int")).drop("__from", "__to"))


def validate(labels: DataFrame, col: str = "cluster", balanced_above: float = 0.1) -> DataFrame:
    """K7: cluster count, min / max size, balance = min/max, balanced flag (label -1 ignored)."""
    sizes = labels.filter(F.col(col) != -1).groupBy(col).agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.count(F.lit(1)).alias("n_clusters"), F.min("size").alias("min_size"),
                     F.max("size").alias("max_size"),
                     (F.min("size") / F.max("size")).alias("balance")) \
        .withColumn("balanced", F.col("balance") > balanced_above)


# ---------------------------------------------------------------- K10 / K11 / K18


def cluster_dna(df: DataFrame, features: list[str], col: str = "cluster", top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Per cluster and feature: cluster mean, z = (cluster mean - global mean) /
    (global sd + 1e-6), rank by |z|, direction (HAUT / BAS when |z| > 0.1, else MOYENNE).
    Returns (long table, per-cluster summary with size, pct, centroid distance,
    distinctiveness = mean |z| of the top features)."""
    bs = basic_stats(df, features)
    cs = central_sums(df, features, {c: bs[c]["mean"] for c in features})
    sd = {c: math.sqrt(cs[f"m2_{i}"] / (bs[c]["n"] - 1)) if bs[c]["n"] > 1 else float("nan")
          for i, c in enumerate(features)}
    spark = df.sparkSession
    glob = spark.createDataFrame([(c, i, bs[c]["mean"], sd[c]) for i, c in enumerate(features)],
                                 "feature string, ordinal long, g_mean double, g_sd double")
    total = bs["__rows"]
    per = (df.filter(F.col(col) >= 0).groupBy(col)
           .agg(F.count(F.lit(1)).alias("size"), *[F.avg(F.col(f"`{c}`")).alias(c) for c in features]))
    long = per.unpivot([col, "size"], features, "feature", "cluster_mean")
    z = (F.col("cluster_mean") - F.col("g_mean")) / (F.col("g_sd") + 1e-6)
    w = Window.partitionBy(col).orderBy(F.abs(F.col("z")).desc(), F.col("ordinal"))
    dna = (long.join(F.broadcast(glob), "feature").withColumn("z", z)
           .withColumn("abs_rank", F.row_number().over(w))
           .withColumn("direction", F.when(F.abs(F.col("z")) > 0.1,
                                           F.when(F.col("z") > 0, F.lit("HAUT")).otherwise(F.lit("BAS")))
                       .otherwise(F.lit("MOYENNE")))
           .withColumn("pct", F.lit(100.0) * F.col("size") / F.lit(total)))
    summary = dna.groupBy(col, "size", "pct").agg(
        F.sqrt(F.sum((F.col("cluster_mean") - F.col("g_mean")) ** 2)).alias("centroid_distance"),
        F.avg(F.when(F.col("abs_rank") <= top, F.abs(F.col("z")))).alias("distinctiveness"))
    return dna.select(col, "feature", "ordinal", "size", "pct", "cluster_mean", "z", "abs_rank", "direction"), summary


def distinctive_features(dna: DataFrame, top: int = 5) -> DataFrame:
    """Mean |z| per feature across clusters, top features ranked."""
    t = dna.groupBy("feature", "ordinal").agg(F.avg(F.abs(F.col("z"))).alias("mean_abs_z"))
    w = Window.orderBy(F.col("mean_abs_z").desc(), F.col("ordinal"))
    return t.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def with_bands(runs: DataFrame) -> DataFrame:
    """Bands of the separation (silhouette; null where it has none), the balance and the dispersion of each run."""
    s, b, d = F.col("silhouette"), F.col("balance"), F.col("dispersion")
    return (runs.withColumn("separation", F.when(s > 0.5, "forte").when(s > 0.25, "moderee").when(s > 0, "faible").when(s.isNotNull(), "nulle"))
            .withColumn("balance_band", F.when(b > 0.5, "equilibree").when(b > 0.2, "acceptable").when(b.isNotNull(), "desequilibree"))
            .withColumn("dispersion_band", F.when(d > 0.7, "elevee").when(d > 0.4, "moyenne").when(d.isNotNull(), "faible")))


def heatmap_radar(dna: DataFrame, max_heat: int | None = None, max_radar: int | None = None) -> DataFrame:
    """Heatmap and radar (both the z-scores, 0 where missing) and the distribution of the clusters
    (percent), in long form; all features unless a limit is set. (view, cluster, feature, value)"""
    z = F.when(F.col("z").isNull() | F.isnan("z"), 0.0).otherwise(F.col("z"))

    def view(name, most):
        rows = dna if most is None else dna.filter(F.col("ordinal") < most)
        return rows.select(F.lit(name).alias("view"), "cluster", "feature", z.alias("value"))

    share = dna.select(F.lit("distribution").alias("view"), "cluster", F.lit(None).cast("string").alias("feature"),
                       F.col("pct").alias("value")).distinct()
    return view("heatmap", max_heat).unionByName(view("radar", max_radar)).unionByName(share)


def sweep_summary(runs: DataFrame) -> DataFrame:
    """Over all segmentations of a sweep: their number, mean and total groups, the best by silhouette
    (smallest k on ties; none if no silhouette is above 0) and its silhouette."""
    scored = F.when(F.col("silhouette") > 0, F.struct("silhouette", (-F.col("k")).alias("minus_k")))
    return (runs.agg(F.count(F.lit(1)).alias("n_segmentations"), F.avg(F.col("k").cast("double")).alias("mean_groups"),
                     F.sum("k").alias("total_groups"), F.max(scored).alias("b"))
            .select("n_segmentations", "mean_groups", "total_groups", (-F.col("b.minus_k")).alias("best_k"),
                    F.col("b.silhouette").alias("best_silhouette")))


# ---------------------------------------------------------------- K3 / K4 / K5 / K13


def _silhouette(pred: DataFrame, label: str = "prediction") -> float:
    from pyspark.ml.evaluation import ClusteringEvaluator
    return ClusteringEvaluator(featuresCol="features", predictionCol=label).evaluate(pred)


def kmeans_best(vec: DataFrame, k: int, seeds: tuple[int, ...] = (42, 59, 76), max_iter: int = 500,
                min_share: float = 0.05, n_init: int = 15, found: dict | None = None, scored: dict | None = None,
                plain: list[str] | None = None) -> tuple[DataFrame | None, dict]:
    """K3: k-means from ``n_init`` starts for each seed, all at once (lloyd.py), the least inertia of a seed's; each
    seed's labelling is rebalanced (K6) and rejected when fewer than k labels survive; the best silhouette wins (ties:
    the first seed). ``found``: centres of ``lloyd.best_of`` where the caller has them, ``scored``: their
    ``lloyd.silhouettes``, with the features in the columns ``plain``. Returns (key, prediction) frame and info."""
    found = found if found is not None else lloyd.best_of(vec, [k], seeds, n_init, max_iter)
    best, info = None, {"k": k, "silhouette": None, "seed": None, "method": "kmeans", "inertia": None}
    tried: dict = {}
    if scored is not None:
        for s in seeds:
            label, sizes, sil = scored[k, s]
            if (sizes > 0).sum() >= k and (info["silhouette"] is None or sil > info["silhouette"]):
                says = F.array(*[F.lit(int(v)) for v in label])
                best = vec.withColumn("prediction", F.element_at(says, lloyd.nearest(found[k, s][0], plain=plain) + 1).cast("int"))
                info.update(silhouette=sil, seed=s, inertia=found[k, s][1])
        return best, info
    for s in seeds:
        centres, cost = found[k, s]
        mark = tuple(sorted(tuple(round(float(v), 6) for v in c) for c in centres))
        if mark in tried:  # the same groups as an earlier seed's
            continue
        tried[mark] = s
        pred = rebalance(vec.withColumn("prediction", lloyd.nearest(centres)), "prediction", min_share).persist()
        if pred.select("prediction").distinct().count() < k:
            pred.unpersist()
            continue
        sil = _silhouette(pred)
        if info["silhouette"] is None or sil > info["silhouette"]:
            if best is not None:
                best.unpersist()
            best = pred
            info.update(silhouette=sil, seed=s, inertia=cost)
        else:
            pred.unpersist()
    return best, info


def gaussian_mixture(vec: DataFrame, k: int, seed: int = 42, n_init: int = 5) -> DataFrame:
    """K4: full-covariance Gaussian mixture, the likeliest of ``n_init`` starts."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.clustering import GaussianMixture
    with ThreadPoolExecutor(max_workers=n_init) as ex:
        fits = list(ex.map(lambda i: GaussianMixture(k=k, seed=seed + i, featuresCol="features").fit(vec), range(n_init)))
    model = max(fits, key=lambda m: m.summary.logLikelihood)  # ties: the first
    return model.transform(vec).withColumn("prediction", F.col("prediction").cast("int"))


def last_resort(vec: DataFrame, key: str, dims: int, k: int, min_share: float = 0.05, n_init: int = 20) -> tuple[DataFrame, float, str]:
    """K5: k-means on the 3-D coordinates, rebalanced, with their silhouette; where that leaves one group, the
    split of the first feature by quartiles (silhouette 0). Returns (labelled vec, silhouette, method)."""
    from pyspark.ml.feature import VectorAssembler
    axes = axes_3d(vec, key, dims)
    flat = VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(axes).persist()
    centres, _ = lloyd.best_of(flat, [k], (42,), n_init)[k, 42]
    labels = rebalance(flat.withColumn("prediction", lloyd.nearest(centres)), "prediction", min_share)
    if labels.select("prediction").distinct().count() >= 2:
        return vec.join(labels.select(key, "prediction"), key), _silhouette(labels), "kmeans_3d"
    flat.unpersist()
    from pyspark.ml.functions import vector_to_array
    first = vec.withColumn("__first", vector_to_array("features")[0])
    return quartile_labels(first, "__first", k).drop("__first"), 0.0, "quartile"


def quartile_labels(df: DataFrame, col: str, k: int) -> DataFrame:
    """K5's split: two groups at the median; beyond, 1 above the third quartile, 2 below the first, from four groups
    on 3 in the upper half of what is between, 0 for the rest."""
    q1, q2, q3 = quantiles(df, [col], [0.25, 0.5, 0.75])[col]
    x = F.col(f"`{col}`")
    if k == 2:
        lab = F.when(x > F.lit(q2), 1)
    else:
        lab = F.when(x > F.lit(q3), 1).when(x < F.lit(q1), 2)
        if k >= 4:
            lab = lab.when(x > F.lit((q1 + q3) / 2), 3)
    return df.withColumn("prediction", lab.otherwise(0).cast("int"))


def quartile_split(df: DataFrame, col: str, k: int) -> DataFrame:
    """k = 2 splits at the median (x > median -> 1), otherwise q1/q3 buckets 0/1/2."""
    q = quantiles(df, [col], [0.25, 0.5, 0.75])[col]
    x = F.col(f"`{col}`")
    if k == 2:
        lab = F.when(x > F.lit(q[1]), 1).otherwise(0)
    else:
        lab = F.when(x <= F.lit(q[0]), 0).when(x <= F.lit(q[2]), 1).otherwise(2)
    return df.withColumn("prediction", lab.cast("int"))


def _stretched(points: DataFrame, key: str) -> DataFrame:
    """Each axis rescaled to [-10, 10]; one without extent is 0."""
    ext = points.agg(*[F.min(a).alias(f"lo_{a}") for a in "xyz"], *[F.max(a).alias(f"hi_{a}") for a in "xyz"]).first()

    def axis(a):
        lo, wide = ext[f"lo_{a}"], (ext[f"hi_{a}"] or 0.0) - (ext[f"lo_{a}"] or 0.0)
        return ((F.col(a) - F.lit(lo)) / F.lit(wide) * 20 - 10 if wide > 0 else F.lit(0.0)).alias(a)
    return points.select(key, *[axis(a) for a in "xyz"])


def axes_3d(vec: DataFrame, key: str, dims: int) -> DataFrame:
    """K8: (key, x, y, z), each axis in [-10, 10]. Three variables or more: the first three principal components.
    Two: both components and the distance to their centre. One: the value, the sine of a half turn along it, and its
    rank among all rows (ties by the key), by range partitions. No noise is added."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    if dims >= 2:
        p = PCA(k=min(3, dims), inputCol="features", outputCol="__pc").fit(vec).transform(vec)
        arr = vector_to_array("__pc")
        if dims >= 3:
            return _stretched(p.select(key, *[arr[i].alias(a) for i, a in enumerate("xyz")]), key)
        flat = p.select(key, arr[0].alias("x"), arr[1].alias("y"))
        c = flat.agg(F.avg("x").alias("x"), F.avg("y").alias("y")).first()
        far = F.sqrt((F.col("x") - F.lit(c["x"])) ** 2 + (F.col("y") - F.lit(c["y"])) ** 2)
        return _stretched(flat.withColumn("z", far), key)
    from quarry.operators.prepare import row_index
    one = vec.select(key, vector_to_array("features")[0].alias("v"))
    ranked = row_index(one, F.struct("v", key), "z")
    lo, hi = ranked.agg(F.min("v"), F.max("v")).first()
    x = (F.col("v") - F.lit(lo)) / F.lit(hi - lo) * 2 - 1 if lo is not None and hi > lo else F.lit(0.0)
    return _stretched(ranked.withColumn("x", x).withColumn("y", F.sin(F.col("x") * math.pi)), key)


def separated(points: DataFrame, key: str) -> DataFrame:
    """K9: (key, prediction, x, y, z) with each cluster moved 70% toward its point on a radius-8 sphere (angle
    2 pi i / k, elevation +-pi/4 alternating)."""
    found = {r["prediction"]: r for r in points.groupBy("prediction").agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"]).collect()}
    ids = sorted(found)
    k = len(ids)
    if k <= 1:
        return points.select(key, "prediction", "x", "y", "z")
    rows = []
    for i, c in enumerate(ids):
        ang, elev = 2 * math.pi * i / k, math.pi / 4 * (1 if i % 2 == 0 else -1)
        rows.append((c, *[found[c][f"c{a}"] for a in "xyz"], 8 * math.cos(ang) * math.cos(elev), 8 * math.sin(ang) * math.cos(elev), 8 * math.sin(elev)))
    off = points.sparkSession.createDataFrame(rows, "prediction int, cx double, cy double, cz double, tx double, ty double, tz double")
    return (points.join(F.broadcast(off), "prediction")
            .select(key, "prediction", *[(F.col(a) + 0.7 * (F.col(f"t{a}") - F.col(f"c{a}"))).alias(a) for a in "xyz"]))


def coords_3d(pred: DataFrame, key: str, dims: int, axes: DataFrame | None = None) -> DataFrame:
    """K8 + K9: the axes of the labelled vectors, clusters set apart."""
    return separated(labelled_axes(pred, key, dims, axes), key)


def labelled_axes(pred: DataFrame, key: str, dims: int, axes: DataFrame | None = None) -> DataFrame:
    """K8: (key, x, y, z, prediction)."""
    axes = axes if axes is not None else axes_3d(pred, key, dims)
    return axes.join(pred.select(key, "prediction"), key)


def dispersion(points: DataFrame) -> dict:
    """dispersion = min(sd/mean of the distance to the centre, 1) (ddof 0);
    3-D quality = min / max axis variance."""
    c = points.agg(*[F.avg(a).alias(a) for a in "xyz"]).first()
    d = F.sqrt(sum((F.col(a) - F.lit(c[a])) ** 2 for a in "xyz"))
    r = points.agg(F.avg(d).alias("m"), F.stddev_pop(d).alias("s"),
                   *[F.var_pop(a).alias(f"v{a}") for a in "xyz"]).first()
    vs = [r[f"v{a}"] or 0.0 for a in "xyz"]
    return {"dispersion": min(r["s"] / r["m"], 1.0) if r["m"] else 0.0,
            "quality_3d": (min(vs) / max(vs)) if max(vs) > 0 else 0.0}


def plane_axes(plain: DataFrame, key: str, z: list[str], vec: DataFrame) -> DataFrame:
    """K8 for three variables or more as columns: the plain features ``z`` of a cached frame with the axes x, y, z of ``axes_3d``."""
    from pyspark.ml.feature import PCA
    pc = PCA(k=3, inputCol="features", outputCol="__pc").fit(vec).pc.toArray()
    raw = [sum((F.col(c) * F.lit(float(pc[j, i])) for j, c in enumerate(z)), F.lit(0.0)) for i in range(3)]
    ext = plain.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(raw) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for i, a in enumerate("xyz"):
        lo, wide = ext[f"lo{i}"], ext[f"hi{i}"] - ext[f"lo{i}"]
        out.append(((raw[i] - F.lit(lo)) / F.lit(wide) * 20 - 10 if wide > 0 else F.lit(0.0)).alias(a))
    return plain.select(key, *z, *out)


def sweep(df: DataFrame, cols: list[str], key: str, ks=(2, 3, 4, 5), seeds=(42, 59, 76),
          gmm_below: float = 0.2, max_iter: int = 500, n_init: int = 15, unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """K13 (+K3/K4/K5/K7/K12/K15/K16/K18): one clustering per k (skip when rows < max(3k, 10)), the starts of all
    of them in the same passes. ``unique``: the caller knows that no key is null or repeated, so on many rows axes and
    labels are columns of the same frame and need no join.
    Returns (points (k, key, cluster, x, y, z), runs table)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector
    zdf, _ = standardized(df, cols, key)
    spark = df.sparkSession
    if zdf is None:
        return None, spark.createDataFrame([], "k int")
    n = df.count()
    wide = unique and n > lloyd.BLOCK_ROWS and len(cols) >= 3
    if wide:  # plain numbers: a vector a row takes three times the memory
        z = [f"__z{i}" for i in range(len(cols))]
        plain = lloyd.dealt(zdf.select(key, *[F.col(f"`z_{c}`").alias(v) for c, v in zip(cols, z)]), n).persist()
        vec = plain.select(key, array_to_vector(F.array(*z)).alias("features"))
        n = plain.count()
    else:
        vec = VectorAssembler(inputCols=[f"z_{c}" for c in cols], outputCol="features").transform(zdf).drop(*[f"z_{c}" for c in cols])
        vec = lloyd.dealt(vec, n).persist()
        n = vec.count()
    runs, points = [], None
    ks = [k for k in ks if n >= max(3 * k, 10)]
    found = lloyd.best_of(vec, ks, tuple(seeds), n_init, max_iter) if ks else {}
    scored = lloyd.silhouettes(plain.select(*z), found, 0.05) if wide and ks else None
    axes = None
    if ks:
        axes = plane_axes(plain, key, z, vec) if wide else cut_lineage(axes_3d(vec, key, len(cols)))
    for k in ks:
        pred, info = kmeans_best(vec if scored is None else axes.withColumn("features", array_to_vector(F.array(*z))), k, tuple(seeds), max_iter,
                                 found=found, scored=scored, plain=z if wide else None)
        if pred is None or (info["silhouette"] is not None and info["silhouette"] < gmm_below):
            g = rebalance(gaussian_mixture(vec, k), "prediction", 0.05)
            if g.select("prediction").distinct().count() >= 2:  # two groups are enough once small ones are merged
                gs = _silhouette(g)
                if info["silhouette"] is None or gs > info["silhouette"]:
                    pred, info = g, dict(info, silhouette=gs, method="gmm")
        if pred is None:
            pred, sil, method = last_resort(vec, key, len(cols), k)
            info = dict(info, method=method, silhouette=sil)
        sizes = validate(pred, "prediction").first()
        if {"x", "y", "z"} <= set(pred.columns):  # labelled where the axes are
            pts = separated(pred.select(key, "prediction", "x", "y", "z"), key)
            disp = dispersion(pts)
        else:
            joined = labelled_axes(pred, key, len(cols), axes.select(key, "x", "y", "z")).persist()  # centres and dispersion each read it
            pts = separated(joined, key)
            disp = dispersion(pts)
            joined.unpersist()
        runs.append((k, info["method"], info["silhouette"], sizes["min_size"], sizes["max_size"],
                     sizes["balance"], disp["dispersion"], disp["quality_3d"]))
        pred.unpersist()  # the labels of one k at a time; the points follow from the vectors and the centres
        p = pts.withColumn("k", F.lit(k)).withColumnRenamed("prediction", "cluster")
        points = p if points is None else points.unionByName(p)
    # the vectors stay cached for the returned points, which are lazy; the caller's session drops them
    table = spark.createDataFrame(runs, "k int, method string, silhouette double, min_size long, "
                                        "max_size long, balance double, dispersion double, quality_3d double")
    return points, chosen(table)


def chosen(runs: DataFrame) -> DataFrame:
    """0.7 silhouette + 0.3 balance as the composite, and the runs' rank by it (the smallest k on ties); K18's bands."""
    w = Window.orderBy(F.col("composite").desc(), F.col("k"))
    return (with_bands(runs.withColumn("composite", 0.7 * F.col("silhouette") + 0.3 * F.col("balance")))
            .withColumn("choice_rank", F.row_number().over(w)))


def attach_segment(df: DataFrame, labels: DataFrame, key: str, label_col: str = "cluster",
                   out: str = "_EDA_SEGMENT", also: tuple[str, ...] = ()) -> DataFrame:
    """The segment label joins the rows by key (never by position), with the label's columns ``also``."""
    return df.join(labels.select(key, F.col(label_col).alias(out), *also), key, "left")
