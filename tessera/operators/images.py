"""Operators on stacks of images: rows, masks, thresholds, arithmetic, scaling and reductions.

Images are rows (image_id, values). What stays inside an image uses array functions, without a
shuffle; what runs across images goes through the long form and one aggregation by voxel, which
Spark sums in each task before its shuffle. Nulls are skipped by aggregates; NaN propagates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import array_center, array_mean, array_std, array_sum, let, safe_div
from tessera.operators.sizes import sent
from tessera.operators.sums import sum_arrays
from tessera.sources.tables import explode_images

REDUCERS = {
    "mean": lambda c: F.avg(c),
    "median": lambda c: F.percentile(c, 0.5),
    "std": lambda c: F.stddev_pop(c),
    "sum": lambda c: F.sum(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
}


def select_rows(frame: DataFrame, where: Column) -> DataFrame:
    """Rows by a predicate on ids or metadata: the indexing of a stack."""
    return frame.filter(where)


def replace_rows(frame: DataFrame, rows: DataFrame, key: str = "image_id") -> DataFrame:
    """Rows of `rows` in place of those of the same key."""
    return frame.join(rows.select(key), key, "left_anti").unionByName(rows)


def append(first: DataFrame, second: DataFrame, key: str = "image_id") -> DataFrame:
    """second after first; its ids go on after the largest of first."""
    shift = first.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).alias("shift"))
    moved = second.join(F.broadcast(shift)).withColumn(key, F.col(key) + F.col("shift")).drop("shift")
    return first.unionByName(moved)


def apply_mask(frame: DataFrame, mask: DataFrame) -> DataFrame:
    """Only the voxels of mask(voxel_id), in order."""
    keep = F.broadcast(mask.agg(F.sort_array(F.collect_set("voxel_id")).alias("kept")))
    return frame.join(keep).withColumn("values", F.transform("kept", lambda v: F.get(F.col("values"), v))).drop("kept")


def threshold(frame: DataFrame, lower: float | None = None, upper: float | None = None, binarize: bool = False) -> DataFrame:
    """Zero what lies below `upper` (alone), above `lower` (alone) or strictly between both; NaN to 0."""

    def one(x: Column) -> Column:
        x = F.when(F.isnan(x), F.lit(0.0)).otherwise(x)
        if lower is not None and upper is not None:
            gone = (x > lower) & (x < upper)
        elif upper is not None:
            gone = x < upper
        elif lower is not None:
            gone = x > lower
        else:
            gone = F.lit(False)
        kept = F.when(gone, F.lit(0.0)).otherwise(x)
        return F.when(kept != 0, F.lit(1.0)).otherwise(F.lit(0.0)) if binarize else kept

    return frame.withColumn("values", F.transform("values", one))


#: Buckets of a pass of value_at, and values that it sorts at the end.
BUCKETS, SORTED = 4096, 100_000


def value_at(frame: DataFrame, places: Sequence[int], values: str = "values") -> list[float]:
    """The values at places (from 0) in the order of all values of all vectors.

    Each pass counts the values of a range by buckets and goes on with the bucket that holds the place, until its values are few
    or equal; those are counted by value. Counts alone are sent, whatever the number of vectors. Null and NaN values are left
    out, infinite ones are an error, as is a place beyond the values.
    """
    rows, out = frame.select(values), []
    for place in places:
        low, high, last = -np.inf, np.inf, None
        while True:

            def counted(batch: pd.DataFrame, low: float = low, high: float = high) -> np.ndarray:
                x = np.concatenate([np.asarray(v, float) for v in batch[values] if v is not None] or [np.zeros(0)])
                x = x[~np.isnan(x)]
                inside = x[(x >= low) & (x <= high)]
                least, most = (inside.min(), inside.max()) if len(inside) else (np.inf, -np.inf)
                return np.array([(x < low).sum(), len(inside), least, most], float)

            below, n, low, high = _range_of(rows, counted)
            if not below <= place < below + n:
                raise ValueError("a place beyond the values")
            if not (np.isfinite(low) and np.isfinite(high)):
                raise ValueError("vectors hold infinite values")
            if low == high or n <= SORTED or (low, high) == last:  # the last: neighbouring numbers, so few values
                flat = rows.select(F.explode(values).alias("v")).filter(F.col("v").between(low, high) & ~F.isnan("v"))
                for row in flat.groupBy("v").count().orderBy("v").toLocalIterator():  # SORTED rows at most
                    below += row["count"]
                    if place < below:
                        out.append(row["v"])
                        break
                break
            edges, last = np.linspace(low, high, BUCKETS + 1), (low, high)

            def histogram(batch: pd.DataFrame, edges: np.ndarray = edges) -> np.ndarray:
                x = np.concatenate([np.asarray(v, float) for v in batch[values] if v is not None] or [np.zeros(0)])
                return np.histogram(x[(x >= edges[0]) & (x <= edges[-1])], edges)[0].astype(float)

            upto = below + np.cumsum(sum_arrays(rows, histogram))
            b = int(np.searchsorted(upto, place, "right"))
            low, high = float(edges[b]), float(edges[b + 1])
    return out


def _range_of(rows: DataFrame, counted) -> tuple[int, int, float, float]:
    """Sums of the first two numbers, the least of the third and the most of the fourth, over all batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame([counted(batch)], columns=["below", "n", "low", "high"])

    got = rows.mapInPandas(run, "below double, n double, low double, high double").agg(F.sum("below"), F.sum("n"), F.min("low"), F.max("high")).first()
    return int(got[0] or 0), int(got[1] or 0), got[2], got[3]


def threshold_percentile(frame: DataFrame, percent: float) -> DataFrame:
    """Zero what lies below the percentile over all values of all images (between two values, by distance).
    Null and NaN values do not count; without values frame is as it was."""
    n = frame.select(F.explode("values").alias("v")).filter(~F.isnan("v")).count()
    if not n:
        return frame
    at = percent / 100 * (n - 1)
    a, b = value_at(frame, [int(np.floor(at)), int(np.ceil(at))])
    cut = a + (b - a) * (at - np.floor(at))
    return frame.withColumn("values", F.transform("values", lambda x: F.when(x < F.lit(float(cut)), F.lit(0.0)).otherwise(x)))


def arithmetic(frame: DataFrame, op: str, other: float) -> DataFrame:
    """values op other; division by zero follows IEEE through try_divide's null."""
    ops = {
        "add": lambda x: x + other,
        "sub": lambda x: x - other,
        "rsub": lambda x: other - x,
        "mul": lambda x: x * other,
        "div": lambda x: F.try_divide(x, F.lit(other)),
    }
    return frame.withColumn("values", F.transform("values", ops[op]))


def arithmetic_images(first: DataFrame, second: DataFrame, op: str) -> DataFrame:
    """values of both sides' images of one id, place by place."""
    ops = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: F.try_divide(x, y)}
    other = second.select("image_id", F.col("values").alias("other"))
    return first.join(other, "image_id").withColumn("values", F.zip_with("values", "other", ops[op])).drop("other")


def weighted_sum(frame: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum over images of weight times image: voxel_id, value."""
    long = explode_images(frame.join(weights, "image_id"))
    return long.groupBy("voxel_id").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def scale_grand(frame: DataFrame, to: float = 100.0) -> DataFrame:
    """Divide by the mean over all values, times `to`; all zero where that mean is next to 0."""
    grand = F.broadcast(frame.agg((F.sum(array_sum(F.col("values"))) / F.sum(F.size("values"))).alias("grand")))
    scaled = F.transform("values", lambda x: F.when(F.abs("grand") < 1e-12, F.lit(0.0)).otherwise(safe_div(x, F.col("grand")) * to))
    return frame.join(grand).withColumn("values", scaled).drop("grand")


def _per_voxel(frame: DataFrame, **aggregates: Column) -> DataFrame:
    """One row of arrays over voxels, for a broadcast: their length is that of an image."""
    stats = explode_images(frame.select("values")).groupBy("voxel_id").agg(*[c.alias(k) for k, c in aggregates.items()])
    packed = F.array_sort(F.collect_list(F.struct("voxel_id", *aggregates)))
    return F.broadcast(stats.agg(packed.alias("stats")))


def scale_voxels(frame: DataFrame, to: float = 100.0) -> DataFrame:
    """Divide each voxel by its mean over images, times `to`; 0 where that mean is 0."""
    joined = frame.join(_per_voxel(frame, mean=F.avg("value")))
    return joined.withColumn("values", F.zip_with("values", "stats", lambda x, s: safe_div(x, s["mean"]) * to)).drop("stats")


def standardize_voxels(frame: DataFrame, method: str = "zscore") -> DataFrame:
    """Each voxel over images: centred, or also divided by its deviation (ddof 0, 1 where that is 0)."""
    joined = frame.join(_per_voxel(frame, mean=F.avg("value"), sd=F.stddev_pop("value")))

    def one(x: Column, s: Column) -> Column:
        c = x - s["mean"]
        return c if method == "center" else c / F.when(s["sd"] > 1e-12, s["sd"]).otherwise(F.lit(1.0))

    return joined.withColumn("values", F.zip_with("values", "stats", one)).drop("stats")


def standardize_images(frame: DataFrame, method: str = "zscore") -> DataFrame:
    """Each image over its voxels, by the same rule; no shuffle."""
    v = F.col("values")
    if method == "center":
        return frame.withColumn("values", array_center(v))
    spread = F.when(array_std(v) > 1e-12, array_std(v)).otherwise(F.lit(1.0))
    scaled = let(F.struct(array_mean(v).alias("mean"), spread.alias("sd")), lambda s: F.transform(v, lambda x: (x - s["mean"]) / s["sd"]))
    return frame.withColumn("values", scaled)


def reduce_images(frame: DataFrame, how: str, *by: str) -> DataFrame:
    """Over images, for each voxel (and group): voxel_id, value."""
    return explode_images(frame.select(*by, "values")).groupBy(*by, "voxel_id").agg(REDUCERS[how]("value").alias("value"))


def reduce_voxels(frame: DataFrame, how: str) -> DataFrame:
    """Over voxels, for each image: image_id, value. Only the median leaves the array."""
    v = F.col("values")
    plain = {"mean": array_mean(v), "std": array_std(v), "sum": array_sum(v), "min": F.array_min(v), "max": F.array_max(v)}
    if how in plain:
        return frame.select("image_id", plain[how].alias("value"))
    s = F.array_sort(v)
    n = F.size(v)
    middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return frame.select("image_id", middle.alias("value"))


def extract_roi(frame: DataFrame, atlas: DataFrame, how: str = "mean") -> DataFrame:
    """image_id, roi, value: reduced over the voxels of each non-zero region of atlas(voxel_id, roi)."""
    long = explode_images(frame.select("image_id", "values")).join(sent(atlas.filter("roi <> 0")), "voxel_id")
    return long.groupBy("image_id", "roi").agg(REDUCERS[how]("value").alias("value"))


def paint_roi(per_roi: DataFrame, atlas: DataFrame, fill: float | None = None) -> DataFrame:
    """Region values back onto voxels: image_id, voxel_id, value; `fill` outside all regions."""
    ids = per_roi.select("image_id").distinct()
    grid = ids.join(F.broadcast(atlas))
    return grid.join(per_roi, ["image_id", "roi"], "left").select("image_id", "voxel_id", F.coalesce("value", F.lit(fill).cast("double")).alias("value"))


def map_values(frame: DataFrame, function) -> DataFrame:
    """A column expression on every value, as Fisher's transforms."""
    return frame.withColumn("values", F.transform("values", function))


def gram(frame: DataFrame) -> DataFrame:
    """Inner products of voxel pairs over images: x, y, value (x <= y), by partial sums."""
    pairs = frame.select(F.posexplode("values").alias("x", "a"), "values").select("x", "a", F.posexplode("values").alias("y", "b")).filter("x <= y")
    return pairs.groupBy("x", "y").agg(F.sum(F.col("a") * F.col("b")).alias("value"))

