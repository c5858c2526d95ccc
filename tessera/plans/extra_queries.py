"""Queries of responses, per-target ridge, label tests, spheres and resampled grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import r6
from tessera.operators import inference, matrices, models, prediction, regions, series, simulation, spatial
from tessera.plans.image_queries import LONG
from tessera.plans.matrix_queries import ADJ, flows, node_labels
from tessera.plans.model_queries import ALPHAS, DESIGN, design, voxel_design
from tessera.plans.registry import query
from tessera.plans.series_queries import BY, S
from tessera.plans.series_queries import series as daily
from tessera.plans.spatial_queries import VOX, long
from tessera.sources.tables import images, table

KERNEL = series.response_kernel(2.0)


def rounded(frame, *columns):
    return frame.withColumns({c: r6(F.col(c)) for c in columns})


@query(
    "series_response_convolve",
    f"WITH {S} SELECT subject, row_id, round("
    + " + ".join(f"coalesce(lag(value, {k}) OVER (PARTITION BY subject ORDER BY row_id), 0) * {w!r}::DOUBLE" for k, w in enumerate(KERNEL))
    + ", 6) + 0.0 AS value FROM S",
)
def series_response_convolve(spark, d):
    return rounded(series.convolve(daily(spark, d), BY, KERNEL), "value").select("subject", "row_id", "value")


@query("series_beats_per_minute", f"WITH {S} SELECT subject, row_id, round(120 / (1 + abs(value)), 6) + 0.0 AS value FROM S")
def series_beats_per_minute(spark, d):
    return daily(spark, d).select("subject", "row_id", r6(series.beats_per_minute(2.0, 1 + F.abs("value"))).alias("value"))


_STAT = "P AS (SELECT i, j, avg(value) - 1 AS stat, (i * 31 + j * 17) % 100 / 100.0::DOUBLE AS p FROM A GROUP BY i, j)"


def stats(spark, d):
    s = flows(spark, d).groupBy("i", "j").agg((F.avg("value") - 1).alias("stat"))
    return s.withColumn("p", (F.col("i") * 31 + F.col("j") * 17) % 100 / F.lit(100.0))


@query("matrix_threshold_by_p", f"WITH {ADJ}, {_STAT} SELECT i, j, round(CASE WHEN p < 0.25 THEN stat ELSE 0 END, 6) + 0.0 AS stat FROM P")
def matrix_threshold_by_p(spark, d):
    return rounded(matrices.threshold_by_p(stats(spark, d), 0.25), "stat").drop("p")


@query("matrix_multi_threshold", f"WITH {ADJ}, {_STAT} SELECT i, j, (CASE WHEN p < 0.1 THEN sign(stat) ELSE 0 END + CASE WHEN p < 0.3 THEN sign(stat) ELSE 0 END)::DOUBLE AS stat FROM P")
def matrix_multi_threshold(spark, d):
    return matrices.multi_threshold(stats(spark, d), [0.1, 0.3]).drop("p")


@query("matrix_distance_correlation_corrected")
def matrix_distance_correlation_corrected(spark, d):
    q = matrices.full_square(flows(spark, d))
    return matrices.corrected_distance_correlation(q, q.withColumn("value", F.sqrt("value")))


@query(
    "matrix_label_test",
    f"""WITH {ADJ}, R AS (SELECT unnest(generate_series(0, 19)) AS replicate), V AS (SELECT replicate, n_regionkey AS label, CASE WHEN replicate = 0 THEN n_nationkey ELSE (n_nationkey * 7 + replicate) % 25 END AS node FROM R, nation),
    N2 AS (SELECT a.replicate, a.label AS li, b.label AS lj, value FROM A JOIN V a ON A.i = a.node JOIN V b ON A.j = b.node AND a.replicate = b.replicate),
    E AS (SELECT replicate, li AS label, li = lj AS same, value FROM N2 UNION ALL SELECT replicate, lj, false, value FROM N2 WHERE li <> lj),
    D AS (SELECT replicate, label, avg(value) FILTER (WHERE NOT same) - avg(value) FILTER (WHERE same) AS m FROM E GROUP BY ALL)
    SELECT o.label, round(o.m, 6) + 0.0 AS stat, round((count(*) FILTER (WHERE abs(s.m) >= abs(o.m) - 1e-12) + 1) / (count(*) + 1)::DOUBLE, 6) + 0.0 AS p
    FROM D o JOIN D s ON o.label = s.label AND o.replicate = 0 AND s.replicate > 0 AND s.m IS NOT NULL AND o.m IS NOT NULL GROUP BY o.label, o.m""".replace("FROM A JOIN V a ON A.i = a.node JOIN V b ON A.j = b.node", "FROM A e JOIN V a ON e.i = a.node JOIN V b ON e.j = b.node"),
)
def matrix_label_test(spark, d):
    moves = spark.range(25).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("replicate"))
    moves = moves.withColumn("to", F.when(F.col("replicate") == 0, F.col("i")).otherwise((F.col("i") * 7 + F.col("replicate")) % 25))
    return rounded(matrices.label_distance_test(flows(spark, d), node_labels(spark, d), moves), "stat", "p")


@query(
    "ols_residuals",
    """SELECT l_orderkey, l_linenumber, round(a + b * q, 6) + 0.0 AS predicted, round(p - a - b * q, 6) + 0.0 AS residual FROM
    (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity / 50 AS q, l_extendedprice / 10000 AS p FROM lineitem) JOIN
    (SELECT l_returnflag, regr_intercept(l_extendedprice / 10000, l_quantity / 50) AS a, regr_slope(l_extendedprice / 10000, l_quantity / 50) AS b FROM lineitem GROUP BY 1) USING (l_returnflag)""",
)
def ols_residuals(spark, d):
    f, few = design(spark, d), ["one", "quantity"]
    fit = models.with_fit(f, models.fit_linear(f, few, "price", ["l_returnflag"]), few, "price", ["l_returnflag"])
    return rounded(fit.select("l_orderkey", "l_linenumber", "predicted", "residual"), "predicted", "residual")


@query("ridge_cv_by_voxel")
def ridge_cv_by_voxel(spark, d):
    f = voxel_design(spark, d).withColumn("fold", F.pmod("image_id", F.lit(5)))
    return models.ridge_cv_by_target(f, ["one", "early", "odd"], "value", "fold", ["voxel_id"], ALPHAS)


@query("ridge_held_out")
def ridge_held_out(spark, d):
    f = design(spark, d).withColumn("fold", F.col("l_orderkey") % 5)
    fits = models.ridge_by_fold(f, DESIGN, "price", "fold", ["l_returnflag"], ALPHAS)
    return models.with_fit(f, fits, DESIGN, "price", ["l_returnflag", "fold"]).select("l_orderkey", "l_linenumber", "fold", "predicted", "residual")


@query(
    "image_resample",
    f"""WITH {LONG}, {VOX} SELECT image_id, CAST(i // 2 * 4 + j // 2 * 2 + k // 2 AS INTEGER) AS voxel_id, round(value, 6) + 0.0 AS value FROM L JOIN V USING (voxel_id) WHERE i % 2 = 1 AND j % 2 = 1 AND k % 2 = 1""",
)
def image_resample(spark, d):
    return rounded(spatial.resample_nearest(long(spark, d), spatial.grid(spark, 4), spatial.grid(spark, 2), 2.0), "value")


@query("predict_searchlight")
def predict_searchlight(spark, d):
    named = images(spark, d).select("image_id", (F.col("label") < 5).cast("int").alias("y"), F.pmod("image_id", F.lit(5)).alias("fold"))
    f = spatial.sphere_features(long(spark, d), spatial.grid(spark, 4), 1.0).join(named, "image_id")
    w = prediction.cross_validated_weights(prediction.region_sums(f, ["center_id"], "x", "y", "fold"), ["center_id"], "lda")
    scores = prediction.cross_validated_scores(f, w, ["center_id"], "x", "y", "fold", True)
    return scores.groupBy("center_id").agg(F.avg("score").alias("score"))


@query("cluster_peaks")
def cluster_peaks(spark, d):
    v = spatial.grid(spark, 4)
    return spatial.separate_peaks(regions.clusters(long(spark, d), v, 0.15, 2), v, 2.0)


@query("bootstrap_splits")
def bootstrap_splits(spark, d):
    return inference.bootstrap_splits(table(spark, d, "embeddings").select("vec_id"), "vec_id", 20)


@query("simulate_correlated")
def simulate_correlated(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey"), simulation.normal(1, "c_custkey").alias("y"))
    return simulation.correlated_with(c, "y", 0.7, "c_custkey", 2)


@query(
    "collection_memory",
    "SELECT label, count(*) AS n_images, (count(*) * max(len(embedding)) * 4)::BIGINT AS bytes FROM embeddings GROUP BY label",
)
def collection_memory(spark, d):
    return images(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n_images"), (F.count(F.lit(1)) * F.max(F.size("values")) * 4).alias("bytes"))
