"""Queries of tests and linear models over embeddings and lineitem."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.columns import r6
from tessera.functions.distributions import p_of_f, p_of_t, z_of_p
from tessera.operators import models as op
from tessera.plans.image_queries import LONG
from tessera.plans.registry import query
from tessera.sources.tables import explode_images, images, table

DESIGN = ["one", "quantity", "discount", "tax"]


def long(spark, d):
    return explode_images(images(spark, d))


def design(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        "l_returnflag", "l_orderkey", "l_linenumber", F.lit(1.0).alias("one"), (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10).alias("discount"),
        (F.col("l_tax") * 10).alias("tax"), (F.col("l_extendedprice") / 10000).alias("price"),
    )


def rounded(frame, *columns):
    return frame.withColumns({c: r6(F.col(c)) for c in columns})


_T = "round(coalesce(avg(value) / nullif(stddev_samp(value) / sqrt(count(*)), 0), 0), 6) + 0.0"


@query("group_voxel_ttest", f"WITH {LONG} SELECT label, voxel_id, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, {_T} AS t FROM L GROUP BY ALL")
def group_voxel_ttest(spark, d):
    return rounded(op.one_sample_t(long(spark, d), "value", ["label", "voxel_id"]), "mean", "t").withColumn("voxel_id", F.col("voxel_id").cast("long"))


@query("voxel_ttest", f"WITH {LONG} SELECT voxel_id, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, {_T} AS t FROM L GROUP BY ALL")
def voxel_ttest(spark, d):
    return rounded(op.one_sample_t(long(spark, d), "value", ["voxel_id"]), "mean", "t").withColumn("voxel_id", F.col("voxel_id").cast("long"))


@query("voxel_ttest_p")
def voxel_ttest_p(spark, d):
    t = op.one_sample_t(long(spark, d), "value", ["voxel_id"]).withColumn("p", p_of_t("t", (F.col("n") - 1).cast("double")))
    return t.withColumn("z", z_of_p("p", "t"))


_G = "avg(value) FILTER (WHERE label < 5) AS m1, avg(value) FILTER (WHERE label >= 5) AS m2, var_samp(value) FILTER (WHERE label < 5) AS v1, var_samp(value) FILTER (WHERE label >= 5) AS v2, count(*) FILTER (WHERE label < 5) AS n1, count(*) FILTER (WHERE label >= 5) AS n2"


@query(
    "voxel_ttest2_pooled",
    f"""WITH {LONG}, G AS (SELECT voxel_id, {_G} FROM L GROUP BY voxel_id) SELECT voxel_id, round(m1 - m2, 6) + 0.0 AS mean,
    round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) + 0.0 AS t, (n1 + n2 - 2)::DOUBLE AS df FROM G""",
)
def voxel_ttest2_pooled(spark, d):
    return rounded(op.two_sample_t(long(spark, d), "value", F.col("label") < 5, ["voxel_id"]), "mean", "t").withColumn("voxel_id", F.col("voxel_id").cast("long"))


@query(
    "voxel_ttest2_welch",
    f"""WITH {LONG}, G AS (SELECT voxel_id, {_G} FROM L GROUP BY voxel_id) SELECT voxel_id, round(m1 - m2, 6) + 0.0 AS mean,
    round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) + 0.0 AS t,
    round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 6) + 0.0 AS df FROM G""",
)
def voxel_ttest2_welch(spark, d):
    made = op.two_sample_t(long(spark, d), "value", F.col("label") < 5, ["voxel_id"], equal_var=False)
    return rounded(made, "mean", "t", "df").withColumn("voxel_id", F.col("voxel_id").cast("long"))


@query(
    "voxel_anova",
    f"""WITH {LONG}, G AS (SELECT voxel_id, label, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM L GROUP BY ALL),
    T AS (SELECT voxel_id, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM G GROUP BY voxel_id)
    SELECT voxel_id, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 6) + 0.0 AS f, (k - 1)::BIGINT AS df_between, (n - k)::BIGINT AS df_within FROM T""",
)
def voxel_anova(spark, d):
    return rounded(op.anova(long(spark, d), "value", "label", ["voxel_id"]), "f").withColumn("voxel_id", F.col("voxel_id").cast("long"))


@query("voxel_anova_p")
def voxel_anova_p(spark, d):
    made = op.anova(long(spark, d), "value", "label", ["voxel_id"])
    return made.withColumn("p", p_of_f("f", F.col("df_between").cast("double"), F.col("df_within").cast("double")))


@query(
    "simple_regression",
    """SELECT l_returnflag, count(*) AS n, round(regr_intercept(p, q), 6) + 0.0 AS intercept, round(regr_slope(p, q), 6) + 0.0 AS slope, round(regr_r2(p, q), 6) + 0.0 AS r2
    FROM (SELECT l_returnflag, l_quantity / 50 AS q, l_extendedprice / 10000 AS p FROM lineitem) GROUP BY l_returnflag""",
)
def simple_regression(spark, d):
    made = op.simple_regression(design(spark, d), "quantity", "price", ["l_returnflag"])
    return rounded(made, "intercept", "slope", "r2").drop("slope_se", "t")


@query(
    "cross_products",
    """SELECT l_returnflag, n, round(a, 4) + 0.0 AS xx_11, round(b, 4) + 0.0 AS xx_12, round(c, 4) + 0.0 AS xy_1, round(e, 4) + 0.0 AS yy FROM
    (SELECT l_returnflag, count(*) AS n, sum(q * q) AS a, sum(q * x) AS b, sum(q * p) AS c, sum(p * p) AS e
     FROM (SELECT l_returnflag, l_quantity / 50 AS q, l_discount * 10 AS x, l_extendedprice / 10000 AS p FROM lineitem) GROUP BY l_returnflag)""",
)
def cross_products(spark, d):
    s = op.cross_products(design(spark, d), ["quantity", "discount"], "price", ["l_returnflag"])
    r4 = lambda c: F.round(c, 4) + F.lit(0.0)
    return s.select(
        "l_returnflag", "n", r4(F.get("xx", F.lit(0))).alias("xx_11"), r4(F.get("xx", F.lit(1))).alias("xx_12"), r4(F.get("xy", F.lit(0))).alias("xy_1"), r4(F.col("yy")).alias("yy")
    )


@query("ols_by_group")
def ols_by_group(spark, d):
    return op.fit_linear(design(spark, d), DESIGN, "price", ["l_returnflag"])


@query(
    "ols_slope",
    """SELECT l_returnflag, term, round(CASE term WHEN 'one' THEN i ELSE s END, 6) + 0.0 AS effect, round(r2, 6) + 0.0 AS r2 FROM
    (SELECT l_returnflag, regr_intercept(p, q) AS i, regr_slope(p, q) AS s, regr_r2(p, q) AS r2 FROM (SELECT l_returnflag, l_quantity / 50 AS q, l_extendedprice / 10000 AS p FROM lineitem) GROUP BY l_returnflag),
    (SELECT unnest(['one', 'quantity']) AS term)""",
)
def ols_slope(spark, d):
    fit = op.fit_linear(design(spark, d), ["one", "quantity"], "price", ["l_returnflag"])
    return rounded(fit.select("l_returnflag", "term", "effect", "r2"), "effect", "r2")


@query("glm_contrasts")
def glm_contrasts(spark, d):
    return op.fit_linear(design(spark, d), DESIGN, "price", ["l_returnflag"], contrasts={"q-d": "quantity - discount", "2d+t": "2*discount + tax"})


def voxel_design(spark, d):
    """Samples are images; the target is a voxel's value, the regressors group indicators."""
    return long(spark, d).withColumns({"one": F.lit(1.0), "early": (F.col("label") < 5).cast("double"), "odd": (F.col("label") % 2).cast("double")})


@query(
    "glm_voxels",
    f"""WITH {LONG}, G AS (SELECT voxel_id, avg(value) FILTER (WHERE label < 5) AS a, avg(value) FILTER (WHERE label >= 5) AS b FROM L GROUP BY voxel_id)
    SELECT voxel_id, term, round(CASE term WHEN 'one' THEN b ELSE a - b END, 6) + 0.0 AS effect FROM G, (SELECT unnest(['one', 'early']) AS term)""",
)
def glm_voxels(spark, d):
    fit = op.fit_linear(voxel_design(spark, d), ["one", "early"], "value", ["voxel_id"])
    return fit.select(F.col("voxel_id").cast("long"), "term", r6(F.col("effect")).alias("effect"))


@query("glm_voxel_contrasts")
def glm_voxel_contrasts(spark, d):
    fit = op.fit_linear(voxel_design(spark, d), ["one", "early", "odd"], "value", ["voxel_id"], contrasts={"early - odd": "early - odd"})
    return fit.withColumn("z", z_of_p("p", "t"))


@query("ridge_fixed")
def ridge_fixed(spark, d):
    return op.fit_linear(design(spark, d), DESIGN, "price", ["l_returnflag"], alpha=1.0).select("l_returnflag", "term", "effect")


ALPHAS = np.logspace(-2, 4, 20).tolist()


@query("ridge_cv")
def ridge_cv(spark, d):
    return op.ridge_cv(design(spark, d).withColumn("fold", F.col("l_orderkey") % 5), DESIGN, "price", "fold", ALPHAS)


@query("ridge_best_alpha")
def ridge_best_alpha(spark, d):
    return op.best_alpha(ridge_cv(spark, d))


@query("design_vif")
def design_vif(spark, d):
    from tessera.functions.columns import corr_of_moments, moments

    names = ["quantity", "discount", "tax", "price"]
    frame = design(spark, d)
    parts = [frame.agg(*moments(a, b)).select(F.lit(i).alias("i"), F.lit(j).alias("j"), corr_of_moments().alias("r")) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    corr = parts[0]
    for p in parts[1:]:
        corr = corr.union(p)
    kept = set(op.clean_columns(corr, names, 0.9))
    rows = [(n, v, n in kept) for n, v in zip(names, op.vif(corr, names), strict=True)]
    return spark.createDataFrame(rows, "name string, vif double, kept boolean")
