"""Queries of the image operators over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import fisher_r_to_z, fisher_z_to_r, r6
from tessera.operators import images as op
from tessera.plans.registry import query
from tessera.sources.tables import explode_images, images

#: DuckDB's long form of the images.
LONG = """L AS (SELECT vec_id AS image_id, label, generate_subscripts(embedding, 1) - 1 AS voxel_id, unnest(embedding)::DOUBLE AS value FROM embeddings)"""


def out(frame):
    """Long form, rounded: what the queries return."""
    return explode_images(frame.select("image_id", "values")).select("image_id", F.col("voxel_id").cast("long"), r6(F.col("value")).alias("value"))


def sql(value: str, more: str = "", source: str = "L") -> str:
    return f"WITH {LONG}{more} SELECT image_id, voxel_id, round({value}, 6) + 0.0 AS value FROM {source}"


def simple(name, change, value, more="", source="L"):
    """A query that changes images, and the SQL expression of each value."""
    query(name, sql(value, more, source))(lambda spark, d: out(change(images(spark, d))))


simple("image_select_rows", lambda i: op.select_rows(i, (F.col("image_id") % 3 == 0) & (F.col("label") < 5)), "value", source="L WHERE image_id % 3 = 0 AND label < 5")
simple(
    "image_threshold_upper", lambda i: op.threshold(i, upper=0.05), "CASE WHEN value < 0.05 THEN 0 ELSE value END"
)
simple("image_threshold_lower", lambda i: op.threshold(i, lower=-0.05), "CASE WHEN value > -0.05 THEN 0 ELSE value END")
simple(
    "image_threshold_band", lambda i: op.threshold(i, lower=-0.1, upper=0.1), "CASE WHEN value > -0.1 AND value < 0.1 THEN 0 ELSE value END"
)
simple(
    "image_threshold_binarize",
    lambda i: op.threshold(i, upper=0.05, binarize=True),
    "CASE WHEN value >= 0.05 AND value <> 0 THEN 1.0 ELSE 0.0 END",
)
simple(
    "image_threshold_percentile",
    lambda i: op.threshold_percentile(i, 90),
    "CASE WHEN value < cut THEN 0 ELSE value END",
    ", P AS (SELECT quantile_cont(value, 0.9) AS cut FROM L)",
    "L, P",
)
for _op, _sign in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):
    simple(f"image_scalar_{_op}", lambda i, o=_op: op.arithmetic(i, o, 2.5), f"value {_sign} 2.5::DOUBLE")
    simple(
        f"image_pair_{_op}",
        lambda i, o=_op: op.arithmetic_images(
            i.filter("image_id < 100"), i.filter("image_id >= 100").withColumn("image_id", F.col("image_id") - 100).filter("image_id < 100"), o
        ),
        f"CASE WHEN {int(_op == 'div')} = 1 AND b.value = 0 THEN NULL ELSE a.value {_sign} b.value END",
        source="(SELECT a.image_id, a.voxel_id, a.value AS av, b.value AS bv FROM L a JOIN L b ON b.image_id = a.image_id + 100 AND a.voxel_id = b.voxel_id WHERE a.image_id < 100)".replace(
            "a.value AS av, b.value AS bv", "a AS a, b AS b"
        ),
    )
    simple(
        f"image_pair_{_op}_all",  # image 2k with image 2k + 1
        lambda i, o=_op: op.arithmetic_images(
            i.filter("image_id % 2 = 0").withColumn("image_id", F.expr("image_id div 2")), i.filter("image_id % 2 = 1").withColumn("image_id", F.expr("image_id div 2")), o
        ),
        f"CASE WHEN {int(_op == 'div')} = 1 AND b = 0 THEN NULL ELSE a {_sign} b END",
        source="(SELECT a.image_id // 2 AS image_id, a.voxel_id, a.value AS a, b.value AS b FROM L a JOIN L b ON b.image_id = a.image_id + 1 AND a.voxel_id = b.voxel_id WHERE a.image_id % 2 = 0)",
    )
simple("image_scalar_rsub", lambda i: op.arithmetic(i, "rsub", 1.0), "1.0::DOUBLE - value")
simple("image_fisher_r_to_z", lambda i: op.map_values(i, lambda x: fisher_r_to_z(x / 2)), "atanh(value / 2)", source="L")
simple("image_fisher_z_to_r", lambda i: op.map_values(i, fisher_z_to_r), "tanh(value)")
simple(
    "image_scale_grand",
    lambda i: op.scale_grand(i),
    "value / grand * 100",
    ", G AS (SELECT avg(value) AS grand FROM L)",
    "L, G",
)
simple("image_scale_voxels", lambda i: op.scale_voxels(i), "value / avg(value) OVER (PARTITION BY voxel_id) * 100")
simple("image_center_voxels", lambda i: op.standardize_voxels(i, "center"), "value - avg(value) OVER (PARTITION BY voxel_id)")
simple(
    "image_zscore_voxels",
    lambda i: op.standardize_voxels(i),
    "(value - avg(value) OVER (PARTITION BY voxel_id)) / stddev_pop(value) OVER (PARTITION BY voxel_id)",
)
simple("image_center_images", lambda i: op.standardize_images(i, "center"), "value - avg(value) OVER (PARTITION BY image_id)")
simple(
    "image_zscore_images",
    lambda i: op.standardize_images(i),
    "(value - avg(value) OVER (PARTITION BY image_id)) / stddev_pop(value) OVER (PARTITION BY image_id)",
)


def _mask(spark):
    return spark.range(64).select(F.col("id").cast("int").alias("voxel_id")).filter("voxel_id % 3 = 1")


@query("image_apply_mask", f"WITH {LONG} SELECT image_id, CAST((voxel_id - 1) / 3 AS BIGINT) AS voxel_id, round(value, 6) + 0.0 AS value FROM L WHERE voxel_id % 3 = 1")
def image_apply_mask(spark, d):
    return out(op.apply_mask(images(spark, d), _mask(spark)))


@query(
    "image_replace_rows",
    f"WITH {LONG} SELECT image_id, voxel_id, round(CASE WHEN image_id % 50 = 0 THEN value * 2 ELSE value END, 6) + 0.0 AS value FROM L",
)
def image_replace_rows(spark, d):
    i = images(spark, d)
    return out(op.replace_rows(i, op.arithmetic(i.filter("image_id % 50 = 0"), "mul", 2.0)))


@query(
    "image_append",
    f"""WITH {LONG} SELECT image_id, voxel_id, round(value, 6) + 0.0 AS value FROM L UNION ALL
    SELECT image_id + (SELECT max(vec_id) + 1 FROM embeddings), voxel_id, round(value, 6) + 0.0 FROM L WHERE label = 3""",
)
def image_append(spark, d):
    i = images(spark, d)
    return out(op.append(i, i.filter("label = 3")))


@query(
    "image_weighted_sum",
    f"WITH {LONG} SELECT voxel_id, round(sum(value * (label + 1)), 6) + 0.0 AS value FROM L GROUP BY voxel_id",
)
def image_weighted_sum(spark, d):
    i = images(spark, d)
    weights = i.select("image_id", (F.col("label") + 1.0).alias("weight"))
    return op.weighted_sum(i, weights).select(F.col("voxel_id").cast("long"), r6(F.col("value")).alias("value"))


_SQL_REDUCE = {"mean": "avg(value)", "median": "quantile_cont(value, 0.5)", "std": "stddev_pop(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)"}

for _how, _agg in _SQL_REDUCE.items():
    query(f"image_{_how}_over_images", f"WITH {LONG} SELECT voxel_id, round({_agg}, 6) + 0.0 AS value FROM L GROUP BY voxel_id")(
        lambda spark, d, h=_how: op.reduce_images(images(spark, d), h).select(F.col("voxel_id").cast("long"), r6(F.col("value")).alias("value"))
    )
    query(f"image_{_how}_over_voxels", f"WITH {LONG} SELECT image_id, round({_agg}, 6) + 0.0 AS value FROM L GROUP BY image_id")(
        lambda spark, d, h=_how: op.reduce_voxels(images(spark, d), h).select("image_id", r6(F.col("value")).alias("value"))
    )


def atlas(spark):
    """Eight voxels a region; region 0 is background."""
    return spark.range(64).select(F.col("id").cast("int").alias("voxel_id"), F.floor(F.col("id") / 8).cast("int").alias("roi"))


for _how in ("mean", "median", "std"):
    query(
        f"image_roi_{_how}",
        f"WITH {LONG} SELECT image_id, CAST(voxel_id // 8 AS INTEGER) AS roi, round({_SQL_REDUCE[_how]}, 6) + 0.0 AS value FROM L WHERE voxel_id >= 8 GROUP BY ALL",
    )(lambda spark, d, h=_how: op.extract_roi(images(spark, d), atlas(spark), h).select("image_id", "roi", r6(F.col("value")).alias("value")))


@query(
    "image_roi_paint",
    f"""WITH {LONG}, R AS (SELECT image_id, voxel_id // 8 AS roi, avg(value) AS m FROM L WHERE voxel_id >= 8 GROUP BY ALL)
    SELECT L.image_id, L.voxel_id, round(R.m, 6) + 0.0 AS value FROM L LEFT JOIN R ON L.image_id = R.image_id AND L.voxel_id // 8 = R.roi""",
)
def image_roi_paint(spark, d):
    painted = op.paint_roi(op.extract_roi(images(spark, d), atlas(spark)), atlas(spark))
    return painted.select("image_id", F.col("voxel_id").cast("long"), r6(F.col("value")).alias("value"))


# collections: a label is a subject, its images are the observations

_GROUP = {"mean": "avg(value)", "std": "sqrt(var_samp(value))", "var": "var_samp(value)", "median": "quantile_cont(value, 0.5)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)"}
_GROUP_AGG = {**op.REDUCERS, "std": lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)), "var": lambda c: F.coalesce(F.var_samp(c), F.lit(0.0))}

for _how, _agg in _GROUP.items():
    _value = f"coalesce({_agg}, 0)" if _how in ("std", "var") else _agg
    query(f"collection_{_how}", f"WITH {LONG} SELECT label, voxel_id, round({_value}, 6) + 0.0 AS value FROM L GROUP BY ALL")(
        lambda spark, d, h=_how: explode_images(images(spark, d))
        .groupBy("label", "voxel_id")
        .agg(_GROUP_AGG[h]("value").alias("value"))
        .select("label", F.col("voxel_id").cast("long"), r6(F.col("value")).alias("value"))
    )


@query(
    "collection_concat",
    f"WITH {LONG} SELECT label, count(DISTINCT image_id) AS n_images, count(*) AS n_values, round(sum(value), 6) + 0.0 AS total FROM L GROUP BY label",
)
def collection_concat(spark, d):
    long = explode_images(images(spark, d))
    return long.groupBy("label").agg(
        F.countDistinct("image_id").alias("n_images"), F.count(F.lit(1)).alias("n_values"), r6(F.sum("value")).alias("total")
    )


@query(
    "image_gram",
    f"""WITH {LONG} SELECT a.voxel_id AS x, b.voxel_id AS y, round(sum(a.value * b.value), 6) + 0.0 AS value
    FROM L a JOIN L b ON a.image_id = b.image_id AND a.voxel_id <= b.voxel_id GROUP BY ALL""",
)
def image_gram(spark, d):
    return op.gram(images(spark, d)).select(F.col("x").cast("long"), F.col("y").cast("long"), r6(F.col("value")).alias("value"))


@query(
    "image_shape",
    "SELECT count(*) AS n_images, max(len(embedding))::BIGINT AS n_voxels, count(*) = 0 AS is_empty FROM embeddings",
)
def image_shape(spark, d):
    return images(spark, d).agg(
        F.count(F.lit(1)).alias("n_images"), F.max(F.size("values")).cast("long").alias("n_voxels"), (F.count(F.lit(1)) == 0).alias("is_empty")
    )


@query(
    "image_equal",
    "SELECT count(*) AS n, count(*) FILTER (WHERE a.embedding = b.embedding) AS equal_images FROM embeddings a JOIN embeddings b USING (vec_id)",
)
def image_equal(spark, d):
    a, b = images(spark, d), images(spark, d).select("image_id", F.col("values").alias("other"))
    return a.join(b, "image_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("values") == F.col("other"), 1)).alias("equal_images"))


