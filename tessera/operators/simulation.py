"""Simulated data, made where it lies: values are functions of seed and ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import safe_div


def normal(seed: int, *ids: str) -> Column:
    """A standard normal number named by ids, the same on every run: Box and Muller's from two hashes."""
    u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *ids), F.lit(1 << 52)) + 0.5) / float(1 << 52) for k in (1, 2)]
    return F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * math.pi * u[1])


def gaussian(voxels: DataFrame, centre: tuple[float, float, float], sigma: float, total: float = 1.0) -> DataFrame:
    """voxel_id, value: a Gaussian bump whose values sum to total."""
    d2 = sum((F.col(n) - c) ** 2 for n, c in zip("ijk", centre, strict=True))
    raw = voxels.withColumn("g", F.exp(-d2 / (2 * sigma * sigma)))
    whole = F.broadcast(raw.agg(F.sum("g").alias("s")))
    return raw.join(whole).select("voxel_id", (F.col("g") / F.col("s") * total).alias("value"))


def images_with_signal(spark: SparkSession, voxels: DataFrame, signal: DataFrame, levels: list[float], reps: int, sigma: float, seed: int = 0) -> DataFrame:
    """image_id, level, voxel_id, value: signal(voxel_id) raised by each level, reps times, plus noise."""
    n = len(levels) * reps
    images = spark.range(n).select(F.col("id").alias("image_id"), F.get(F.array(*[F.lit(float(x)) for x in levels]), F.floor(F.col("id") / reps).cast("int")).alias("level"))
    marked = voxels.join(F.broadcast(signal.withColumn("on", F.lit(1.0))), "voxel_id", "left")
    grid = images.join(F.broadcast(marked))
    return grid.select("image_id", "level", "voxel_id", (F.col("level") * F.coalesce("on", F.lit(0.0)) + sigma * normal(seed, "image_id", "voxel_id")).alias("value"))


def noise_grid(spark: SparkSession, width: int, subjects: int, signal_width: int, amplitude: float, sigma: float, runs: int = 1, seed: int = 0) -> DataFrame:
    """run, subject, cell, on, value: squares of noise with a square of signal in the middle."""
    lo = (width - signal_width) // 2
    cells = spark.range(runs * subjects * width * width).select(
        F.floor(F.col("id") / (subjects * width * width)).alias("run"), F.pmod(F.floor(F.col("id") / (width * width)), F.lit(subjects)).alias("subject"), (F.col("id") % (width * width)).alias("cell")
    )
    inside = F.floor(F.col("cell") / width).between(lo, lo + signal_width - 1) & (F.col("cell") % width).between(lo, lo + signal_width - 1)
    return cells.select("run", "subject", "cell", inside.alias("on"), (F.when(inside, amplitude).otherwise(0.0) + sigma * normal(seed, "run", "subject", "cell")).alias("value"))


def detection_rates(cells: DataFrame, t_threshold: float) -> DataFrame:
    """run, tpr, fpr, fdr of one-sample t over subjects with |t| > threshold in each cell."""
    s = cells.groupBy("run", "cell", "on").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"), F.count(F.lit(1)).alias("n"))
    t = F.coalesce(safe_div(F.col("m"), F.col("sd") / F.sqrt("n")), F.lit(0.0))
    found = s.withColumn("found", F.abs(t) > t_threshold)
    hits, false = F.sum((F.col("found") & F.col("on")).cast("long")), F.sum((F.col("found") & ~F.col("on")).cast("long"))
    on, off = F.sum(F.col("on").cast("long")), F.sum((~F.col("on")).cast("long"))
    return found.groupBy("run").agg(safe_div(hits, on).alias("tpr"), safe_div(false, off).alias("fpr"), safe_div(false, hits + false).alias("fdr"))


def correlated_with(frame: DataFrame, y: str, r: float, key: str, seed: int = 0) -> DataFrame:
    """frame with x: standard normal noise mixed with a standardised y, to a correlation of r."""
    noise = normal(seed, key)
    return frame.withColumn("x", F.lit(float(r)) * F.col(y) + F.lit(math.sqrt(1 - r * r)) * noise)
