"""Registered segmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import segment as K
from quarry.plans import fixtures as FX
from quarry.plans.common import finish, oracle_finish, register
from quarry.sources.tables import load, with_row_key

FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

REBALANCE_SQL = """
WITH s AS (SELECT l_linenumber AS c, count(*) AS size FROM lineitem GROUP BY 1),
t AS (SELECT sum(size) AS total FROM s),
v AS (SELECT min(c) AS first_valid FROM s, t WHERE size >= floor(total * 0.05))
SELECT l_orderkey, l_linenumber,
       CAST(CASE WHEN s.size < floor(t.total * 0.05) THEN v.first_valid ELSE l_linenumber END AS INTEGER) AS cluster
FROM lineitem JOIN s ON l_linenumber = s.c, t, v"""


def _rebalanced(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                            F.col("l_linenumber").alias("cluster"))
    return K.rebalance(li, "cluster", 0.05)


@register("cluster_rebalance", REBALANCE_SQL)
def q_cluster_rebalance(spark, sf):
    return _rebalanced(spark, sf)


@register("cluster_validation", oracle_finish(f"""
SELECT count(*) AS n_clusters, min(size) AS min_size, max(size) AS max_size,
       min(size) * 1.0 / max(size) AS balance, min(size) * 1.0 / max(size) > 0.1 AS balanced
FROM (SELECT cluster, count(*) AS size FROM ({REBALANCE_SQL}) r WHERE cluster <> -1 GROUP BY cluster) s""",
    ["balance"]))
def q_cluster_validation(spark, sf):
    return finish(K.validate(_rebalanced(spark, sf), "cluster"))


def _dna_sql():
    glob = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({i} AS BIGINT) AS ordinal, avg({c}) AS g_mean, stddev_samp({c}) AS g_sd "
        f"FROM given_labels" for i, c in enumerate(FEATS))
    per = " UNION ALL ".join(
        f"SELECT cluster, '{c}' AS feature, count(*) AS size, avg({c}) AS cluster_mean FROM given_labels "
        f"WHERE cluster >= 0 GROUP BY cluster" for c in FEATS)
    return f"""
WITH g AS ({glob}), p AS ({per}),
z AS (SELECT p.cluster, p.feature, g.ordinal, p.size, p.cluster_mean, g.g_mean,
             (p.cluster_mean - g.g_mean) / (g.g_sd + 1e-6) AS z FROM p JOIN g ON p.feature = g.feature)
SELECT cluster, feature, ordinal, size,
       100.0 * size / (SELECT count(*) FROM given_labels) AS pct, cluster_mean, z,
       CAST(row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, ordinal) AS INTEGER) AS abs_rank,
       CASE WHEN abs(z) > 0.1 THEN CASE WHEN z > 0 THEN 'HAUT' ELSE 'BAS' END ELSE 'MOYENNE' END AS direction,
       g_mean
FROM z"""


@register("cluster_dna", FX.with_views(oracle_finish(
    "SELECT * EXCLUDE (g_mean) FROM (" + _dna_sql() + ") d", ["pct", "cluster_mean", "z"], ["cluster", "abs_rank"]),
    "given_labels"))
def q_cluster_dna(spark, sf):
    dna, _ = K.cluster_dna(FX.given_labels(spark, sf), FEATS)
    return finish(dna)


@register("cluster_summary", FX.with_views(oracle_finish(
    "SELECT cluster, size, pct, sqrt(sum((cluster_mean - g_mean) * (cluster_mean - g_mean))) AS centroid_distance, "
    "avg(CASE WHEN abs_rank <= 5 THEN abs(z) END) AS distinctiveness FROM (" + _dna_sql() + ") d "
    "GROUP BY cluster, size, pct", ["pct", "centroid_distance", "distinctiveness"], ["cluster"]), "given_labels"))
def q_cluster_summary(spark, sf):
    _, summary = K.cluster_dna(FX.given_labels(spark, sf), FEATS)
    return finish(summary)


@register("distinctive_features", FX.with_views(oracle_finish(
    "SELECT feature, ordinal, mean_abs_z, CAST(row_number() OVER (ORDER BY mean_abs_z DESC, ordinal) AS INTEGER) AS \"rank\" "
    "FROM (SELECT feature, ordinal, avg(abs(z)) AS mean_abs_z FROM (" + _dna_sql() + ") d GROUP BY feature, ordinal) t "
    "QUALIFY \"rank\" <= 5", ["mean_abs_z"], ['"rank"']), "given_labels"))
def q_distinctive_features(spark, sf):
    dna, _ = K.cluster_dna(FX.given_labels(spark, sf), FEATS)
    return finish(K.distinctive_features(dna))


@register("cluster_heatmap_radar", FX.with_views(oracle_finish(
    "WITH d AS (" + _dna_sql() + ") SELECT 'heatmap' AS view, cluster, feature, z AS value FROM d "
    "UNION ALL SELECT 'radar', cluster, feature, z FROM d "
    "UNION ALL SELECT DISTINCT 'distribution', cluster, CAST(NULL AS VARCHAR), pct FROM d",
    ["value"], ["cluster"]), "given_labels"))
def q_cluster_heatmap_radar(spark, sf):
    dna, _ = K.cluster_dna(FX.given_labels(spark, sf), FEATS)
    return finish(K.heatmap_radar(dna))


#: Segmentations whose quality SQL can compute: lines dealt by line number into 2 to 5 groups, with the
#: share of quantity variance that lies between the groups in the place of the silhouette.
_GROUPINGS = " UNION ALL ".join(f"SELECT {k} AS k, l_linenumber % {k} AS g, l_quantity AS q FROM lineitem" for k in range(2, 6))


@register("sweep_summary", oracle_finish(f"""
WITH x AS ({_GROUPINGS}),
m AS (SELECT k, avg(q) AS gm, var_pop(q) AS total FROM x GROUP BY k),
b AS (SELECT x.k, g, count(*) AS n, avg(q) AS mean FROM x GROUP BY x.k, g),
r AS (SELECT b.k, sum(n * (mean - gm) * (mean - gm)) / sum(n) / min(total) AS silhouette FROM b JOIN m USING (k) GROUP BY b.k)
SELECT count(*) AS n_segmentations, avg(k) AS mean_groups, CAST(sum(k) AS BIGINT) AS total_groups,
       CAST(arg_max(k, silhouette) AS BIGINT) AS best_k, max(silhouette) AS best_silhouette FROM r""", ["mean_groups", "best_silhouette"]))
def q_sweep_summary(spark, sf):
    """K15 over four groupings of the lines."""
    li = load(spark, sf, "lineitem").select("l_linenumber", F.col("l_quantity").alias("q"))
    x = (li.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(2, 6)])))
         .withColumn("g", F.col("l_linenumber") % F.col("k")))
    total = x.groupBy("k").agg(F.avg("q").alias("gm"), F.var_pop("q").alias("total"))
    groups = x.groupBy("k", "g").agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("mean"))
    runs = (groups.join(total, "k").groupBy("k")
            .agg((F.sum(F.col("n") * (F.col("mean") - F.col("gm")) ** 2) / F.sum("n") / F.min("total")).alias("silhouette")))
    return finish(K.sweep_summary(runs))


@register("median_split", """
SELECT l_orderkey, l_linenumber,
       CAST(CASE WHEN l_extendedprice > (SELECT quantile_cont(l_extendedprice, 0.5) FROM lineitem) THEN 1 ELSE 0 END
            AS INTEGER) AS prediction
FROM lineitem""")
def q_median_split(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return K.quartile_split(li, "l_extendedprice", 2).drop("l_extendedprice")


def _keyed_lineitem(spark, sf):
    return with_row_key(load(spark, sf, "lineitem").select(*FEATS))


@register("kmeans_sweep")
def q_kmeans_sweep(spark, sf):
    """One clustering per k = 2..5 with silhouette, balance, dispersion and the
    composite choice (seeded Spark ML fits; rows-only check)."""
    _, runs = K.sweep(_keyed_lineitem(spark, sf), FEATS, "row_key", ks=(2, 3, 4, 5), unique=True)
    return runs


@register("segment_points")
def q_segment_points(spark, sf):
    """Every row's 3-D point and segment of the sweep's choice among k = 2..5, attached by key (rows-only)."""
    df = _keyed_lineitem(spark, sf)
    pts, runs = K.sweep(df, FEATS, "row_key", unique=True)
    pts = pts.filter(F.col("k") == runs.filter("choice_rank = 1").first()["k"])
    return K.attach_segment(df, pts, "row_key", also=("x", "y", "z")).filter("x IS NOT NULL")  # every point has its x


@register("axes_of_one", """
WITH v AS (SELECT o_orderkey, o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS r FROM orders),
x AS (SELECT o_orderkey, r, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 2 - 1 AS x FROM v),
y AS (SELECT *, sin(x * pi()) AS y FROM x)
SELECT o_orderkey, round(x * 10, 4) + 0.0 AS x, round((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) * 20 - 10, 4) + 0.0 AS y,
       round(r::DOUBLE / max(r) OVER () * 20 - 10, 4) + 0.0 AS z FROM y""")
def q_axes_of_one(spark, sf):
    """K8 for one variable: value, sine and rank axes of the orders' prices."""
    vec, _ = K.standardize(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "o_orderkey")
    return K.axes_3d(vec, "o_orderkey", 1).select("o_orderkey", *[(F.round(a, 4) + F.lit(0.0)).alias(a) for a in "xyz"])


SEPARATED_SQL = """
WITH p AS (SELECT vec_id, label AS prediction, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z
           FROM embeddings),
c AS (SELECT prediction, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, row_number() OVER (ORDER BY prediction) - 1 AS i, count(*) OVER () AS k
      FROM p GROUP BY prediction),
t AS (SELECT *, 8 * cos(2 * pi() * i / k) * cos(pi() / 4) AS tx, 8 * sin(2 * pi() * i / k) * cos(pi() / 4) AS ty,
             8 * sin(CASE WHEN i % 2 = 0 THEN pi() / 4 ELSE -pi() / 4 END) AS tz FROM c)
SELECT vec_id, prediction, CASE WHEN k > 1 THEN x + 0.7 * (tx - cx) ELSE x END AS x, CASE WHEN k > 1 THEN y + 0.7 * (ty - cy) ELSE y END AS y,
       CASE WHEN k > 1 THEN z + 0.7 * (tz - cz) ELSE z END AS z FROM p JOIN t USING (prediction)"""


def _labelled_points(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", F.col("label").cast("int").alias("prediction"),
                                                *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])


@register("separated_points", f"SELECT vec_id, CAST(prediction AS BIGINT) AS prediction, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, "
                              f"round(z, 6) + 0.0 AS z FROM ({SEPARATED_SQL}) s")
def q_separated_points(spark, sf):
    """K9 over the labels of the embeddings, their first three coordinates as points."""
    p = K.separated(_labelled_points(spark, sf), "vec_id")
    return p.select("vec_id", F.col("prediction").cast("long").alias("prediction"), *[(F.round(a, 6) + F.lit(0.0)).alias(a) for a in "xyz"])


@register("point_dispersion", f"""
WITH s AS ({SEPARATED_SQL}), c AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM s),
d AS (SELECT sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) AS d, x, y, z FROM s, c),
r AS (SELECT avg(d) AS m, stddev_pop(d) AS sd, var_pop(x) AS vx, var_pop(y) AS vy, var_pop(z) AS vz FROM d)
SELECT round(least(sd / m, 1.0), 8) AS dispersion, round(least(vx, vy, vz) / greatest(vx, vy, vz), 8) AS quality_3d FROM r""")
def q_point_dispersion(spark, sf):
    """K12 of the separated points."""
    d = K.dispersion(K.separated(_labelled_points(spark, sf), "vec_id"))
    return spark.createDataFrame([(round(d["dispersion"], 8), round(d["quality_3d"], 8))], "dispersion double, quality_3d double")


@register("segment_attached", """
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber % 3 END AS BIGINT) AS "_EDA_SEGMENT" FROM lineitem""")
def q_segment_attached(spark, sf):
    """Labels of two thirds of the rows, attached by key; the others stay without."""
    li = with_row_key(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))
    labels = li.select("row_key", (F.col("l_linenumber") % 3).cast("long").alias("cluster")).filter("cluster > 0")
    return K.attach_segment(li, labels, "row_key").drop("row_key")


@register("run_choice", oracle_finish("""
SELECT *, 0.7 * silhouette + 0.3 * balance AS composite, row_number() OVER (ORDER BY 0.7 * silhouette + 0.3 * balance DESC, k) AS choice_rank,
       CASE WHEN silhouette > 0.5 THEN 'forte' WHEN silhouette > 0.25 THEN 'moderee' WHEN silhouette > 0 THEN 'faible' ELSE 'nulle' END AS separation,
       CASE WHEN balance > 0.5 THEN 'equilibree' WHEN balance > 0.2 THEN 'acceptable' ELSE 'desequilibree' END AS balance_band,
       CASE WHEN dispersion > 0.7 THEN 'elevee' WHEN dispersion > 0.4 THEN 'moyenne' ELSE 'faible' END AS dispersion_band
FROM (SELECT l_linenumber AS k, round(2 * avg(l_discount) * l_linenumber, 6) AS silhouette, round(min(l_quantity) / max(l_quantity) * l_linenumber * 7, 6) AS balance,
             round(avg(l_quantity) / max(l_extendedprice) * 400 * l_linenumber, 6) AS dispersion FROM lineitem GROUP BY l_linenumber) r""",
    ["silhouette", "balance", "dispersion", "composite"], ["k"]))
def q_run_choice(spark, sf):
    """K16 + K18: composite, choice and bands of runs whose figures are aggregates of the lines."""
    k = F.col("l_linenumber")
    runs = (load(spark, sf, "lineitem").groupBy("l_linenumber").agg(
        F.round(2 * F.avg("l_discount") * k, 6).alias("silhouette"), F.round(F.min("l_quantity") / F.max("l_quantity") * k * 7, 6).alias("balance"),
        F.round(F.avg("l_quantity") / F.max("l_extendedprice") * 400 * k, 6).alias("dispersion")).withColumnRenamed("l_linenumber", "k"))
    return finish(K.chosen(runs))
