"""Queries of volume files: the images written as volumes and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import r6
from tessera.plans.image_queries import LONG
from tessera.plans.inference_queries import subject_images
from tessera.plans.registry import query
from tessera.sources import volumes
from tessera.sources.scratch import Scratch, keep


@query(
    "volume_round_trip",
    f"""WITH {LONG}, T AS (SELECT vec_id AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t FROM embeddings)
    SELECT 'sub-' || label AS series, t, voxel_id, round(value, 6) + 0.0 AS value FROM L JOIN T USING (image_id) WHERE label IS NOT NULL""",
)
def volume_round_trip(spark, d):
    """A label is a series of 4 x 4 x 4 volumes; all images, in one space."""
    rows = subject_images(spark, d).filter("subject IS NOT NULL").withColumn("series", F.concat(F.lit("sub-"), F.col("subject").cast("string")))
    with Scratch(spark, "volumes") as scratch:
        volumes.write_volumes(rows, scratch.folder, (4, 4, 4))
        back = volumes.read_volumes(spark, scratch.folder)
        volumes.check_space(back, (4, 4, 4))
        kept = keep(back.select("series", "t", "values"), "read-back")
    long = kept.select("series", "t", F.posexplode("values").alias("voxel_id", "value"))
    return long.select("series", "t", F.col("voxel_id").cast("long").alias("voxel_id"), r6(F.col("value")).alias("value"))
