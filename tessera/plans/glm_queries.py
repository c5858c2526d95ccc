"""Queries of linear models of whole images over time: a label is a run, the order of its images time, all voxels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import r6
from tessera.operators import glm_images as gi
from tessera.plans.image_queries import LONG
from tessera.plans.inference_queries import rounded, subject_images
from tessera.plans.registry import query

COLUMNS = ["one", "x"]
#: The series Y with its regressors, a voxel and time a row.
_SERIES = f"""{LONG}, T AS (SELECT vec_id AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t FROM embeddings),
Y AS (SELECT label AS run, t, voxel_id, 1.0::DOUBLE AS one, (t * 37 % 11) / 11.0::DOUBLE AS x, value AS y FROM L JOIN T USING (image_id) WHERE label IS NOT NULL)"""
#: Least squares of y on one and x by run and voxel, from sums.
_FIT = """SELECT run, voxel_id, count(*) AS n, sum(one * one) AS aa, sum(one * x) AS ab, sum(x * x) AS bb, sum(one * y) AS ay, sum(x * y) AS by_, sum(y * y) AS yy
FROM {} GROUP BY ALL"""
_SOLVED = """SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS b0, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS b1 FROM {}"""
_TERMS = """SELECT run, voxel_id, term, rho, CASE term WHEN 'one' THEN b0 ELSE b1 END AS effect,
sqrt(greatest(yy - b0 * ay - b1 * by_, 0) / (n - 2) * CASE term WHEN 'one' THEN bb ELSE aa END / (aa * bb - ab * ab)) AS se, (n - 2)::DOUBLE AS df
FROM {}, (SELECT unnest(['one', 'x']) AS term)"""
_OUT = "SELECT run, voxel_id, term, round(rho, 6) + 0.0 AS rho, round(effect, 6) + 0.0 AS effect, round(se, 6) + 0.0 AS se, round(effect / se, 4) + 0.0 AS t, df FROM"


def runs(spark, d):
    return subject_images(spark, d).filter("subject IS NOT NULL").withColumnRenamed("subject", "run")


def design(spark, d):
    return runs(spark, d).select("run", "t", F.lit(1.0).alias("one"), (F.col("t") * 37 % 11 / 11.0).alias("x"))


def terms(fit):
    made = rounded(fit, "rho", "effect", "se").select("run", "voxel_id", "term", "rho", "effect", "se", F.col("t"), "df")
    return made.withColumn("t", F.round("t", 4) + 0.0)


@query("glm_images_ols", f"WITH {_SERIES}, S AS ({_FIT.format('Y')}), B AS ({_SOLVED.format('S')}), O AS ({_TERMS.format('(SELECT *, 0.0::DOUBLE AS rho FROM B)')}) {_OUT} O")
def glm_images_ols(spark, d):
    return terms(gi.fit_images(runs(spark, d), design(spark, d), COLUMNS))


@query(
    "glm_images_ar1",
    f"""WITH {_SERIES}, S AS ({_FIT.format("Y")}), B AS ({_SOLVED.format("S")}),
    E AS (SELECT Y.*, y - b0 - b1 * x AS e FROM Y JOIN B USING (run, voxel_id)),
    G AS (SELECT *, lag(e) OVER w AS e_, lag(one) OVER w AS one_, lag(x) OVER w AS x_, lag(y) OVER w AS y_ FROM E WINDOW w AS (PARTITION BY run, voxel_id ORDER BY t)),
    R AS (SELECT run, voxel_id, trunc(sum(e * e_) / sum(e * e) * 100) / 100 AS rho FROM G GROUP BY ALL),
    W AS (SELECT run, voxel_id, rho, one - rho * coalesce(one_, 0) AS one, x - rho * coalesce(x_, 0) AS x, y - rho * coalesce(y_, 0) AS y FROM G JOIN R USING (run, voxel_id)),
    S2 AS ({_FIT.format("W")}), B2 AS ({_SOLVED.format("S2")}), O AS ({_TERMS.format("(SELECT * FROM B2 JOIN R USING (run, voxel_id))")}) {_OUT} O""",
)
def glm_images_ar1(spark, d):
    return terms(gi.fit_images(runs(spark, d), design(spark, d), COLUMNS, "ar1"))


@query(
    "glm_images_fixed_effects",
    f"""WITH {_SERIES}, S AS ({_FIT.format("Y")}), B AS ({_SOLVED.format("S")}), O AS ({_TERMS.format("(SELECT *, 0.0::DOUBLE AS rho FROM B)")})
    SELECT voxel_id, term, round(avg(effect), 6) + 0.0 AS effect, round(sqrt(sum(se * se)) / count(*), 6) + 0.0 AS se, count(*) AS n_runs FROM O GROUP BY ALL""",
)
def glm_images_fixed_effects(spark, d):
    made = gi.fixed_effects(gi.fit_images(runs(spark, d), design(spark, d), COLUMNS))
    return rounded(made, "effect", "se").drop("t")


@query(
    "glm_images_residuals",
    f"""WITH {_SERIES}, S AS ({_FIT.format("Y")}), B AS ({_SOLVED.format("S")})
    SELECT run, t, voxel_id, round(b0 + b1 * x, 6) + 0.0 AS predicted, round(y - b0 - b1 * x, 6) + 0.0 AS residual FROM Y JOIN B USING (run, voxel_id)""",
)
def glm_images_residuals(spark, d):
    i, x = runs(spark, d), design(spark, d)
    made = gi.predict_images(i, x, gi.fit_images(i, x, COLUMNS), COLUMNS)
    both = made.select("run", "t", F.posexplode(F.arrays_zip("predicted", "residual")).alias("voxel_id", "v"))
    return both.select("run", "t", F.col("voxel_id").cast("long").alias("voxel_id"), r6(F.col("v.predicted")).alias("predicted"), r6(F.col("v.residual")).alias("residual"))
