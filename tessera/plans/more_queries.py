"""Queries of filters, iterative models and of statistics that combine other operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import r6
from tessera.operators import images as im
from tessera.operators import iterative, models, signals
from tessera.operators.series import phase_summary
from tessera.plans.image_queries import LONG
from tessera.plans.inference_queries import all_subjects
from tessera.plans.matrix_queries import ADJ, flows
from tessera.plans.model_queries import DESIGN, design
from tessera.plans.registry import query
from tessera.plans.series_queries import series
from tessera.plans.spatial_queries import samples
from tessera.sources.tables import explode_images, images


@query("series_resample_pchip")
def series_resample_pchip(spark, d):
    return signals.resample(series(spark, d), ["subject"], 2.0)


@query("series_bandpass")
def series_bandpass(spark, d):
    return signals.bandpass(series(spark, d), ["subject"], 1.0, 0.05, 0.3)


@query("series_phase_randomize")
def series_phase_randomize(spark, d):
    return signals.phase_randomize(series(spark, d), ["subject"])


@query("isps")
def isps(spark, d):
    s = all_subjects(spark, d).withColumnRenamed("t", "row_id")
    return phase_summary(signals.phases(s, ["subject", "voxel_id"], 1.0, 0.05, 0.3), ["voxel_id", "row_id"], "value")


for _loss, _name in (("logistic", "logistic"), ("squared_hinge", "svm")):

    def _fit(spark, d, loss=_loss):
        w = iterative.newton_classifier(samples(spark, d), "roi", "x", "y", loss)
        return spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in sorted(w.items())], "roi int, weights array<double>")

    query(f"predict_{_name}")(_fit)


@query("banded_ridge")
def banded_ridge(spark, d):
    sums = models.cross_products(design(spark, d).withColumn("fold", F.col("l_orderkey") % 5), DESIGN, "price", ["fold"])
    return spark.createDataFrame(iterative.banded_ridge(sums, [0, 0, 1, 1], np.logspace(-2, 3, 6).tolist(), 10))


@query("decompose_pca")
def decompose_pca(spark, d):
    parts, variance = iterative.leading_components(images(spark, d), 5)
    return spark.createDataFrame([(k, float(v), [float(x) for x in p]) for k, (v, p) in enumerate(zip(variance, parts, strict=True))], "component int, variance double, loading array<double>")


@query(
    "multivariate_similarity",
    f"""WITH {LONG}, T AS (SELECT voxel_id, avg(value) AS x FROM L WHERE label = 0 GROUP BY voxel_id)
    SELECT image_id, term, round(CASE term WHEN 'one' THEN regr_intercept(value, x) ELSE regr_slope(value, x) END, 6) + 0.0 AS effect
    FROM L JOIN T USING (voxel_id), (SELECT unnest(['one', 'x']) AS term) GROUP BY image_id, term""",
)
def multivariate_similarity(spark, d):
    """Each image on the mean image of the first group, over voxels."""
    long = explode_images(images(spark, d))
    x = im.reduce_images(images(spark, d).filter("label = 0"), "mean").withColumnRenamed("value", "x")
    fit = models.fit_linear(long.join(F.broadcast(x), "voxel_id").withColumn("one", F.lit(1.0)), ["one", "x"], "value", ["image_id"])
    return fit.select("image_id", "term", r6(F.col("effect")).alias("effect"))


@query(
    "matrix_regress",
    f"""WITH {ADJ}, P AS (SELECT i, j, avg(value) AS x FROM A WHERE matrix_id = 'BUILDING' GROUP BY ALL)
    SELECT matrix_id, term, round(CASE term WHEN 'one' THEN regr_intercept(value, x) ELSE regr_slope(value, x) END, 6) + 0.0 AS effect
    FROM A JOIN P USING (i, j), (SELECT unnest(['one', 'x']) AS term) WHERE matrix_id <> 'BUILDING' GROUP BY matrix_id, term HAVING count(*) > 2""",
)
def matrix_regress(spark, d):
    """Edges as observations: each matrix on one of them."""
    a = flows(spark, d)
    x = a.filter("matrix_id = 'BUILDING'").select("i", "j", F.col("value").alias("x"))
    fit = models.fit_linear(a.filter("matrix_id <> 'BUILDING'").join(x, ["i", "j"]).withColumn("one", F.lit(1.0)), ["one", "x"], "value", ["matrix_id"])
    return fit.filter("df > 0").select("matrix_id", "term", r6(F.col("effect")).alias("effect"))


@query(
    "matrix_regress_design",
    f"""WITH {ADJ}, X AS (SELECT matrix_id, (dense_rank() OVER (ORDER BY matrix_id) - 1)::DOUBLE AS x FROM (SELECT DISTINCT matrix_id FROM A))
    SELECT i, j, term, round(CASE term WHEN 'one' THEN regr_intercept(value, x) ELSE regr_slope(value, x) END, 6) + 0.0 AS effect
    FROM A JOIN X USING (matrix_id), (SELECT unnest(['one', 'x']) AS term) GROUP BY i, j, term HAVING count(*) > 2""",
)
def matrix_regress_design(spark, d):
    """Matrices as observations: each edge on a regressor of the matrices."""
    a = flows(spark, d)
    x = a.select("matrix_id").distinct().withColumn("x", (F.dense_rank().over(Window.orderBy("matrix_id")) - 1).cast("double"))
    fit = models.fit_linear(a.join(F.broadcast(x), "matrix_id").withColumn("one", F.lit(1.0)), ["one", "x"], "value", ["i", "j"])
    return fit.filter("df > 0").select("i", "j", "term", r6(F.col("effect")).alias("effect"))


@query("map_subjects", f"WITH {LONG} SELECT label, count(DISTINCT image_id) AS n_images, round(max(value) - min(value), 6) + 0.0 AS spread FROM L GROUP BY label")
def map_subjects(spark, d):
    import pandas as pd

    def spread(group: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(group["values"].to_list())
        return pd.DataFrame({"label": [group["label"].iloc[0]], "n_images": [len(v)], "spread": [float(v.max() - v.min())]})

    made = iterative.map_groups(images(spark, d), "label", spread, "label int, n_images long, spread double")
    return made.withColumn("spread", r6(F.col("spread")))
