"""Spatial operators: neighbourhoods, cluster tables, peaks, spheres and atlas labels (smoothing is in `searchlight`).

voxels(voxel_id, i, j, k) is the grid's dimension table. A neighbourhood is found by an equi-join on
grid cells, never by comparing all pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.sizes import sent


def grid(spark: SparkSession, n: int) -> DataFrame:
    """A cube of n * n * n voxels, k running fastest."""
    v = F.col("id")
    return spark.range(n**3).select(
        v.cast("int").alias("voxel_id"), F.floor(v / (n * n)).cast("int").alias("i"), F.pmod(F.floor(v / n), F.lit(n)).cast("int").alias("j"), (v % n).cast("int").alias("k")
    )


def neighbourhoods(voxels: DataFrame, radius: float) -> DataFrame:
    """center_id, neighbor_id, d2: voxels within the radius, each voxel's own included.

    Every voxel is copied to the offsets that the radius allows and met there by equality.
    """
    r = math.floor(radius)
    offsets = [(a, b, c) for a, b, c in itertools.product(range(-r, r + 1), repeat=3) if a * a + b * b + c * c <= radius * radius + 1e-9]
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(a * a + b * b + c * c).alias("d2")) for a, b, c in offsets])
    here = voxels.select(F.col("voxel_id").alias("center_id"), "i", "j", "k", F.explode(moves).alias("m"))
    at = here.select("center_id", (F.col("i") + F.col("m.a")).alias("i"), (F.col("j") + F.col("m.b")).alias("j"), (F.col("k") + F.col("m.c")).alias("k"), F.col("m.d2").alias("d2"))
    return at.join(voxels.select(F.col("voxel_id").alias("neighbor_id"), "i", "j", "k"), ["i", "j", "k"]).select("center_id", "neighbor_id", "d2")


def spheres(voxels: DataFrame, centres: list[tuple[float, float, float]], radius: float) -> DataFrame:
    """The voxels within the radius of any centre."""
    inside = F.lit(False)
    for a, b, c in centres:
        inside = inside | ((F.col("i") - a) ** 2 + (F.col("j") - b) ** 2 + (F.col("k") - c) ** 2 <= radius**2 + 1e-9)
    return voxels.filter(inside).select("voxel_id")


def cluster_table(labelled: DataFrame, voxel_volume: float = 1.0) -> DataFrame:
    """image_id, cluster, n_voxels, volume, mean, peak, peak_voxel (the largest |value|)."""
    s = labelled.groupBy("image_id", "cluster").agg(
        F.count(F.lit(1)).alias("n_voxels"), F.avg("value").alias("mean"), F.max(F.struct(F.abs("value").alias("a"), (-F.col("voxel_id")).alias("v"), "value")).alias("p")
    )
    return s.select("image_id", "cluster", "n_voxels", (F.col("n_voxels") * voxel_volume).alias("volume"), "mean", F.col("p.value").alias("peak"), (-F.col("p.v")).alias("peak_voxel"))


def _placed(points: DataFrame, size: int, voxel_mm: float, origin: tuple[float, float, float]) -> DataFrame:
    """points with their voxel (i, j, k); those outside the box have voxel (0, 0, 0)."""
    ijk = {n: F.bround((F.col(c) - o) / voxel_mm).cast("int") for n, c, o in zip("ijk", "xyz", origin, strict=True)}
    placed = points.withColumns(ijk)
    inside = F.lit(True)
    for n in "ijk":
        inside = inside & F.col(n).between(0, size - 1)
    return placed.withColumns({n: F.when(inside, F.col(n)).otherwise(F.lit(0)) for n in "ijk"})


def label_coordinates(points: DataFrame, atlas: DataFrame, size: int, voxel_mm: float, origin: tuple[float, float, float]) -> DataFrame:
    """points(point_id, x, y, z) in mm to atlas(i, j, k, label): rounded half to even to a voxel; points
    outside the box take voxel (0, 0, 0)."""
    clipped = _placed(points, size, voxel_mm, origin)
    return clipped.join(sent(atlas), ["i", "j", "k"], "left").select("point_id", "i", "j", "k", F.coalesce("label", F.lit("no label")).alias("label"))


def label_probabilities(
    points: DataFrame, atlas: DataFrame, size: int, voxel_mm: float, origin: tuple[float, float, float], at_least: float = 5.0
) -> DataFrame:
    """point_id, i, j, k, label of points(point_id, x, y, z) in atlas(i, j, k, label, percent), a row a region that a
    voxel may lie in: "42.0% this; 18.0% that", of the regions of at least `at_least` percent, the likeliest first, ties
    by label; "no label" where none is. A region without a name is "no label" with its percent. Points outside the box
    take voxel (0, 0, 0). The atlas is gathered to a row a voxel before it meets the points.
    """
    kept = atlas.filter(F.col("percent") >= at_least).withColumn("label", F.coalesce("label", F.lit("no label")))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("percent")).alias("less"), "label", "percent")))
    told = F.array_join(F.transform(listed, lambda r: F.concat(F.format_string("%.1f%% ", F.bround(r["percent"], 1)), r["label"])), "; ")
    voxels = kept.groupBy("i", "j", "k").agg(told.alias("label"))
    clipped = _placed(points, size, voxel_mm, origin)
    return clipped.join(sent(voxels), ["i", "j", "k"], "left").select("point_id", "i", "j", "k", F.coalesce("label", F.lit("no label")).alias("label"))


def resample_nearest(long: DataFrame, source: DataFrame, target: DataFrame, ratio: float) -> DataFrame:
    """image_id, voxel_id, value on the target grid, whose voxels are `ratio` source voxels wide: each takes
    the source voxel its centre lies in."""
    place = {n: F.floor((F.col(n) + 0.5) * ratio).cast("int") for n in "ijk"}
    at = target.select(F.col("voxel_id").alias("target_id"), *[c.alias(n) for n, c in place.items()])
    found = at.join(source, ["i", "j", "k"]).select("target_id", "voxel_id")
    return long.join(sent(found), "voxel_id").select("image_id", F.col("target_id").alias("voxel_id"), "value")


def sphere_features(long: DataFrame, voxels: DataFrame, radius: float) -> DataFrame:
    """center_id, image_id, x: each sphere's values in the order of voxels, for models of neighbourhoods."""
    near = sent(neighbourhoods(voxels, radius))
    joined = long.join(near, long["voxel_id"] == near["neighbor_id"])
    packed = F.array_sort(F.collect_list(F.struct("neighbor_id", "value")))
    return joined.groupBy("center_id", "image_id").agg(F.transform(packed, lambda p: p["value"]).alias("x"))


def separate_peaks(labelled: DataFrame, voxels: DataFrame, min_distance: float) -> DataFrame:
    """image_id, cluster, voxel_id, value: a cluster's voxels of largest |value| at least min_distance apart.

    Clusters come to a task one after the other, their voxels from the largest; it holds a batch of rows and the peaks of the
    cluster at hand, whatever a cluster's size or their number."""
    size = F.abs("value")
    placed = labelled.join(sent(voxels), "voxel_id").withColumn("size_", F.when(~F.isnan(size), size))
    rows = placed.repartition("image_id", "cluster").sortWithinPartitions("image_id", "cluster", F.desc_nulls_last("size_"), "voxel_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, peaks = None, []  # the cluster at hand, and its peaks so far
        for batch in batches:
            image, cluster = (batch[c].to_numpy(zero_copy_only=False) for c in ("image_id", "cluster"))
            points = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(float) for c in "ijk"], axis=1)
            begins = np.flatnonzero(np.r_[True, (image[1:] != image[:-1]) | (cluster[1:] != cluster[:-1])]) if len(image) else []
            kept = []
            for lo, hi in itertools.pairwise([*begins, len(image)]):
                if (image[lo], cluster[lo]) != at:
                    at, peaks = (image[lo], cluster[lo]), []
                left = np.arange(lo, hi)
                for p in peaks:
                    left = left[((points[left] - p) ** 2).sum(axis=1) >= min_distance**2]
                while len(left):
                    n, left = left[0], left[1:]
                    peaks.append(points[n])
                    kept.append(n)
                    left = left[((points[left] - points[n]) ** 2).sum(axis=1) >= min_distance**2]
            yield batch.select(["image_id", "cluster", "voxel_id", "value"]).take(pa.array(kept, pa.int64()))

    kinds = "image_id long, cluster long, voxel_id int, value double"
    typed = [F.col(c).cast(kind) for c, kind in (x.split() for x in kinds.split(", "))]
    return rows.select(*typed, "i", "j", "k").mapInArrow(run, kinds)
