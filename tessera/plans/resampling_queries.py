"""Queries of bootstraps over pairs of subjects and of ridge models: all subjects, voxels and times."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import inference, resampling
from tessera.plans.image_queries import LONG
from tessera.plans.inference_queries import _ISC_ALL, _PAIRS, all_subjects, rounded
from tessera.plans.registry import query
from tessera.sources.tables import images

N = 29


def plain_draws(n, replicates):
    """Draws that SQL can make too."""
    j = np.arange(n)[None, :]
    return (replicates[:, None] * 7919 + j * 104729 + replicates[:, None] * j * 31) % n


def plain_weights(ids, replicates):
    w = ((ids[None, :] * 7919 + replicates[:, None] * (ids[None, :] % 31 + 1) * 104729) % 1000003 % 3).astype(float)
    w[replicates == 0] = 1.0
    return w


_NULL = f"""WITH {_ISC_ALL}{_PAIRS}, SUB AS (SELECT label AS s, row_number() OVER (ORDER BY label) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM embeddings)),
D AS (SELECT replicate, j, s FROM (SELECT unnest(generate_series(1, {N})) AS replicate), (SELECT k AS j FROM SUB), SUB WHERE k = (replicate * 7919 + j * 104729 + replicate * j * 31) % n),
P AS (SELECT x.replicate, least(x.s, y.s) AS a, greatest(x.s, y.s) AS b FROM D x JOIN D y ON x.replicate = y.replicate AND x.j < y.j AND x.s <> y.s),
M AS (SELECT replicate, voxel_id, {{0}} AS m FROM P JOIN R USING (a, b) GROUP BY ALL),
O AS (SELECT voxel_id, {{0}} AS isc FROM R GROUP BY voxel_id)
SELECT voxel_id, round(isc, 6) + 0.0 AS isc, round((count(*) FILTER (WHERE abs(m - isc) >= abs(isc) - 1e-12) + 1) / (count(*) + 1.0::DOUBLE), 6) + 0.0 AS p,
round(quantile_cont(m, 0.025), 6) + 0.0 AS lo, round(quantile_cont(m, 0.975), 6) + 0.0 AS hi FROM M JOIN O USING (voxel_id) GROUP BY voxel_id, isc"""

for _how, _sql in (("median", "quantile_cont(r, 0.5)"), ("mean", "tanh(avg(atanh(greatest(least(r, 0.9999), -0.9999))))")):

    def _pairs(spark, d, how=_how):
        rs = inference.isc_pairwise(all_subjects(spark, d))
        return rounded(resampling.isc_pairwise_bootstrap(rs, N, how, plain_draws), "isc", "p", "lo", "hi")

    query(f"isc_pairs_bootstrap_{_how}", _NULL.format(_sql))(_pairs)


@query("isc_group_bootstrap")
def isc_group_bootstrap(spark, d):
    """Groups of even and odd labels; tests/test_resampling.py holds the operator against plain loops."""
    subjects = [r[0] for r in images(spark, d).select("label").distinct().collect() if r[0] is not None]
    return resampling.isc_group_bootstrap(inference.isc_pairwise(all_subjects(spark, d)), {s: s % 2 for s in subjects}, 199)


_RIDGE = f"""WITH {LONG}, K AS (SELECT unnest(generate_series(0, {N})) AS replicate), X AS (SELECT vec_id AS image_id, vec_id % 5 / 5.0::DOUBLE AS x FROM embeddings),
W AS (SELECT replicate, image_id, x, CASE WHEN replicate = 0 THEN 1 ELSE (image_id * 7919 + replicate * (image_id % 31 + 1) * 104729) % 1000003 % 3 END AS w FROM X, K),
S AS (SELECT replicate, voxel_id, sum(w) + 1.0 AS g00, sum(w * x) AS g01, sum(w * x * x) + 1.0 AS g11, sum(w * value) AS c0, sum(w * x * value) AS c1 FROM L JOIN W USING (image_id) GROUP BY ALL),
B AS (SELECT replicate, voxel_id, (g11 * c0 - g01 * c1) / (g00 * g11 - g01 * g01) AS b0, (g00 * c1 - g01 * c0) / (g00 * g11 - g01 * g01) AS b1 FROM S)"""
_DESCRIBED = """round(max(v) FILTER (WHERE replicate = 0), 6) + 0.0 AS {}, round(avg(v) FILTER (WHERE replicate > 0), 6) + 0.0 AS mean, round(stddev_samp(v) FILTER (WHERE replicate > 0), 6) + 0.0 AS std,
round(quantile_cont(v, 0.025) FILTER (WHERE replicate > 0), 6) + 0.0 AS lo, round(quantile_cont(v, 0.975) FILTER (WHERE replicate > 0), 6) + 0.0 AS hi"""


def ridge_images(spark, d):
    return images(spark, d).withColumn("x", F.array(F.lit(1.0), F.col("image_id") % 5 / 5.0))


@query(
    "bootstrap_ridge_weights",
    f"""{_RIDGE}, V AS (SELECT replicate, voxel_id, feature, CASE feature WHEN 0 THEN b0 ELSE b1 END AS v FROM B, (SELECT unnest([0, 1]) AS feature))
    SELECT feature, voxel_id, {_DESCRIBED.format("weight")} FROM V GROUP BY feature, voxel_id""",
)
def bootstrap_ridge_weights(spark, d):
    made = resampling.ridge_weight_bootstrap(ridge_images(spark, d), "x", 2, N, 1.0, plain_weights)
    return rounded(made, "weight", "mean", "std", "lo", "hi").drop("z", "p")


@query(
    "bootstrap_ridge_predictions",
    f"""{_RIDGE}, V AS (SELECT replicate, voxel_id, image_id, b0 + b1 * x AS v FROM B, X)
    SELECT image_id, voxel_id, {_DESCRIBED.format("predicted")} FROM V GROUP BY image_id, voxel_id""",
)
def bootstrap_ridge_predictions(spark, d):
    i = ridge_images(spark, d)
    made = resampling.ridge_prediction_bootstrap(i, i.select("image_id", "x"), "x", 2, N, 1.0, plain_weights)
    return rounded(made, "predicted", "mean", "std", "lo", "hi").drop("z", "p")


@query("bootstrap_ridge_many")
def bootstrap_ridge_many(spark, d):
    """1,999 replicates by hashed Poisson counts."""
    return resampling.ridge_weight_bootstrap(ridge_images(spark, d), "x", 2, 1999)
