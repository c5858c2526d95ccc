"""The tables of the data model, read from Parquet.

images(image_id, label, values): a row an image, values a dense vector over voxels.
long images(image_id, label, voxel_id, value): a row a voxel of an image, for work per voxel.
series(subject, t, value): a regular series a subject. design(row_id, columns...): regressors.
adj(matrix_id, i, j, value): edges of matrices, i < j where symmetric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as images: vec_id is the image, an array place the voxel, label the group."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), "label", F.col("embedding").cast("array<double>").alias("values"))


def explode_images(frame: DataFrame) -> DataFrame:
    """Long form: one row a voxel, voxel_id from 0."""
    others = [c for c in frame.columns if c != "values"]
    return frame.select(*others, F.posexplode("values").alias("voxel_id", "value"))


def collect_images(long: DataFrame, *keys: str) -> DataFrame:
    """Back from the long form: values in the order of voxel_id."""
    packed = F.array_sort(F.collect_list(F.struct("voxel_id", "value")))
    return long.groupBy(*keys).agg(F.transform(packed, lambda x: x["value"]).alias("values"))


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value of each user and day: series(subject, t, value), t in days from 1970."""
    ev = table(spark, sf_dir, "events")
    t = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    return ev.groupBy(F.col("user_id").alias("subject"), t.alias("t")).agg(F.avg("value").alias("value"))


def day_angle(ts: str = "ts") -> Column:
    """Time of day as an angle, in whatever zone the timestamp is written."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), F.col(ts)).cast("double")
    return seconds / 86_400.0 * 6.283185307179586
