"""Running moments of a stream: what the one-pass collection statistics keep, held by the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_moments(stream: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """by..., n, mean, var (ddof 1, 0 for one row), min, max so far: in update or complete mode."""
    return stream.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def windowed_means(stream: DataFrame, ts: str, width: str, late: str, *by: str, value: str = "value") -> DataFrame:
    """by..., start, n, mean of each time window; rows later than the watermark are dropped by the engine."""
    made = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return made.select(*by, F.col("window.start").alias("start"), "n", "mean")
