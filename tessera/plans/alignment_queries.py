"""Queries of Procrustes similarity, matched states and local alignment; tests/test_local_alignment.py holds the operators against numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import alignment, spatial
from tessera.plans.image_queries import LONG
from tessera.plans.inference_queries import rounded, subject_images
from tessera.plans.registry import query
from tessera.sources.tables import images


@query("procrustes_distance")
def procrustes_distance(spark, d):
    """The first half of each image's voxels against the second, all images."""
    halves = images(spark, d).select("image_id", F.slice("values", 1, 32).alias("a"), F.slice("values", 33, 32).alias("b"))
    return alignment.procrustes_distance(halves, "a", "b", "image_id", 49)


_STATES = f"""WITH {LONG}, S AS (SELECT label AS subject, CAST(image_id % 3 AS INTEGER) AS state, voxel_id, avg(value) AS v FROM L WHERE label IS NOT NULL GROUP BY ALL),
M AS (SELECT image_id % 3 AS ref, voxel_id, avg(value) AS v FROM L WHERE label IS NOT NULL GROUP BY ALL),
C AS (SELECT subject, state, ref, 1 - corr(S.v, M.v) AS cost FROM S JOIN M USING (voxel_id) GROUP BY ALL),
P AS (SELECT a * 9 + b * 3 + c AS p, unnest([0, 1, 2]) AS state, unnest([a, b, c]) AS ref FROM range(3) x(a), range(3) y(b), range(3) z(c) WHERE a <> b AND b <> c AND a <> c),
T AS (SELECT subject, p, row_number() OVER (PARTITION BY subject ORDER BY sum(cost)) AS nth FROM C JOIN P USING (state, ref) GROUP BY subject, p)
SELECT subject, C.state, CAST(C.ref AS INTEGER) AS matched, round(cost, 6) + 0.0 AS cost FROM T JOIN P USING (p) JOIN C USING (subject, state, ref) WHERE nth = 1"""


@query("align_states", _STATES)
def align_states(spark, d):
    """Each label's three mean images against those of all labels."""
    i = images(spark, d).filter("label IS NOT NULL").withColumn("state", (F.col("image_id") % 3).cast("int"))
    long = i.select("label", "state", F.posexplode("values").alias("voxel_id", "value"))

    def means(*by):
        mean = long.groupBy(*by, "voxel_id").agg(F.avg("value").alias("v"))
        packed = F.transform(F.array_sort(F.collect_list(F.struct("voxel_id", "v"))), lambda x: x["v"])
        return mean.groupBy(*by).agg(packed.alias("values"))

    reference = np.array([r["values"] for r in means("state").orderBy("state").collect()])  # three vectors
    states = means("label", "state").withColumnRenamed("label", "subject")
    return rounded(alignment.align_states(states, reference), "cost")


def shared_images(spark, d):
    """All voxels at the times that all subjects have."""
    i = subject_images(spark, d).filter("subject IS NOT NULL")
    least = i.groupBy("subject").count().agg(F.min("count").alias("shared"))
    return i.join(F.broadcast(least), F.col("t") < F.col("shared")).drop("shared")


for _method, _features in (("hyperalignment", None), ("srm", 3)):

    def _local(spark, d, method=_method, features=_features):
        return alignment.align_local(shared_images(spark, d), spatial.grid(spark, 4), 1.0, method, features)

    query(f"align_local_{_method}")(_local)
