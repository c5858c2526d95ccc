"""Operators on regular series and design matrices: order is an explicit row id.

A frame has `order`, a row number from 0, inside the keys `by` (a subject or a run). Windows are
partitioned by those keys, never by nothing; what needs the length of a series joins it from one
aggregate. Without keys a frame is one series, and its operators use joins on the row id instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import legendre, safe_div
from tessera.operators.ranks import total_before
from tessera.operators.sizes import sent
from tessera.sources.scratch import keep


def with_row_id(frame: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """row_id from 0 in the order of a column inside each series."""
    return frame.withColumn("row_id", (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("long"))


def _group_stats(frame: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """frame with aggregates of its group joined in, by a partial aggregation rather than a window."""
    stats = frame.groupBy(*by).agg(*[c.alias(k) for k, c in aggregates.items()])
    return frame.join(stats, list(by)) if by else frame.join(F.broadcast(stats))


def zscore(frame: DataFrame, columns: Sequence[str], by: Sequence[str] = (), center_only: bool = False) -> DataFrame:
    """(x - mean) / std with ddof 1; a constant column becomes null."""
    named = {f"{c}_m": F.avg(c) for c in columns} | {f"{c}_s": F.stddev_samp(c) for c in columns}
    joined = _group_stats(frame, by, **named)
    for c in columns:
        centred = F.col(c) - F.col(f"{c}_m")
        joined = joined.withColumn(c, centred if center_only else safe_div(centred, F.col(f"{c}_s"), None))
    return joined.drop(*named)


def quantiles(frame: DataFrame, column: str, by: Sequence[str], **shares: float) -> DataFrame:
    """by... and a linear quantile for each of `shares` by its name; null of a group without values.

    Distinct values are counted and their counts added up over range partitions, which may split a group, so no task has all
    values of one. Null values take no part; NaN is the largest.
    """
    named = frame.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("value_")).agg(F.count(F.lit(1)).alias("n_"))
    counts = keep(named, "quantiles")
    placed = total_before(counts, by, ["value_"], "n_", "before_")
    sums = counts.groupBy(*by).agg(F.sum("n_").alias("all_"))
    met = placed.join(sent(sums), list(by)) if by else placed.join(F.broadcast(sums))
    made = {}
    for name, share in shares.items():
        at = (F.col("all_") - 1) * F.lit(share)
        below, above = (F.max(F.when((F.col("before_") <= k) & (k < F.col("before_") + F.col("n_")), F.col("value_"))) for k in (F.floor(at), F.ceil(at)))
        part = F.max(at - F.floor(at))
        made[name] = F.when(part == 0, below).otherwise((1 - part) * below + part * above)
    found = met.groupBy(*by).agg(*[c.alias(name) for name, c in made.items()])
    return frame.select(*by).distinct().join(found, list(by), "left") if by else found


def outlier_bounds(frame: DataFrame, column: str, by: Sequence[str], how: str, low: float, high: float) -> DataFrame:
    """frame with lo and hi: linear quantiles, or mean -/+ k deviations (ddof 1)."""
    if how == "quantile":
        cut = sent(keep(quantiles(frame, column, by, lo=low, hi=high), "quantiles"))  # a row a group
        return frame.join(cut, list(by)) if by else frame.join(cut)
    return _group_stats(frame, by, lo=F.avg(column) - low * F.stddev_samp(column), hi=F.avg(column) + high * F.stddev_samp(column))


def winsorize(
    frame: DataFrame, column: str, by: Sequence[str] = (), how: str = "quantile", low: float = 0.05, high: float = 0.95, to_cutoff: bool = True
) -> DataFrame:
    """Outliers to the cutoff, or to the nearest value strictly inside."""
    cut = outlier_bounds(frame, column, by, how, low, high)
    x, lo, hi = F.col(column), F.col("lo"), F.col("hi")
    if not to_cutoff:
        inside = cut.filter((x > lo) & (x < hi)).groupBy(*by).agg(F.min(column).alias("lo_in"), F.max(column).alias("hi_in"))
        cut = cut.join(sent(keep(inside, "inside")), list(by), "left") if by else cut.join(F.broadcast(inside))
    floor, ceil = (lo, hi) if to_cutoff else (F.col("lo_in"), F.col("hi_in"))
    return cut.withColumn(column, F.when(x < lo, floor).when(x > hi, ceil).otherwise(x)).drop("lo", "hi", "lo_in", "hi_in")


def trim(frame: DataFrame, column: str, by: Sequence[str] = (), how: str = "std", low: float = 2.0, high: float = 2.0) -> DataFrame:
    """Outliers to null."""
    cut = outlier_bounds(frame, column, by, how, low, high)
    inside = (F.col(column) >= F.col("lo")) & (F.col(column) <= F.col("hi"))
    return cut.withColumn(column, F.when(inside, F.col(column))).drop("lo", "hi")


def fill_missing(frame: DataFrame, columns: Sequence[str], value: float) -> DataFrame:
    """Null and NaN to a value."""
    return frame.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c), F.lit(value)).otherwise(F.col(c)) for c in columns})


def downsample(frame: DataFrame, by: Sequence[str], factor: int, how: str = "mean") -> DataFrame:
    """Means or medians of `factor` rows: by..., row_id, value. A shorter last group stays."""
    agg = {"mean": F.avg("value"), "median": F.percentile("value", 0.5)}[how]
    return frame.groupBy(*by, F.floor(F.col("row_id") / factor).cast("long").alias("row_id")).agg(agg.alias("value"))


def upsample(frame: DataFrame, by: Sequence[str], factor: int, how: str = "linear") -> DataFrame:
    """Values at multiples of 1 / factor up to the last row: each row makes the points after it."""
    nxt = F.lead("value").over(Window.partitionBy(*by).orderBy("row_id"))
    made = frame.withColumn("next", nxt).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    made = made.filter("next IS NOT NULL")
    share = F.col("k") / F.lit(float(factor))
    linear = F.col("value") + (F.col("next") - F.col("value")) * share
    nearest = F.when(F.col("k") * 2 <= factor, F.col("value")).otherwise(F.col("next"))  # halves go down
    return made.select(*by, (F.col("row_id") * factor + F.col("k")).alias("row_id"), (linear if how == "linear" else nearest).alias("value"))


def detrend(frame: DataFrame, by: Sequence[str], how: str = "linear") -> DataFrame:
    """Residuals of value on a constant, or on a constant and the row id."""
    t, v = F.col("row_id").cast("double"), F.col("value")
    if how == "constant":
        return _group_stats(frame, by, m_=F.avg(v)).withColumn("value", v - F.col("m_")).drop("m_")
    joined = _group_stats(frame, by, mv_=F.avg(v), mt_=F.avg(t), cov_=F.covar_pop(t, v), var_=F.var_pop(t))
    slope = safe_div(F.col("cov_"), F.col("var_"))
    return joined.withColumn("value", v - F.col("mv_") - slope * (t - F.col("mt_"))).drop("mv_", "mt_", "cov_", "var_")


def find_spikes(frame: DataFrame, by: Sequence[str], k: float = 3.0) -> DataFrame:
    """by..., row_id, global_spike, diff_spike: outside mean +/- k deviations (ddof 0) of the values, and
    of the absolute differences to the next row (the earlier row is marked)."""
    step = F.abs(F.lead("value").over(Window.partitionBy(*by).orderBy("row_id")) - F.col("value"))
    diffed = frame.withColumn("step", step)
    joined = _group_stats(diffed, by, mv=F.avg("value"), sv=F.stddev_pop("value"), ms=F.avg("step"), ss=F.stddev_pop("step"))

    def outside(x: str, m: str, s: str) -> Column:
        return F.coalesce((F.col(x) > F.col(m) + k * F.col(s)) | (F.col(x) < F.col(m) - k * F.col(s)), F.lit(False))

    return joined.select(*by, "row_id", outside("value", "mv", "sv").alias("global_spike"), outside("step", "ms", "ss").alias("diff_spike"))


def circle_shift(frame: DataFrame, by: Sequence[str], shift: Column) -> DataFrame:
    """Row t goes to (t + shift) modulo the length: only ids change, no row moves."""
    joined = _group_stats(frame, by, n_=F.count(F.lit(1)))
    return joined.withColumn("row_id", F.pmod(F.col("row_id") + shift, F.col("n_"))).drop("n_")


def convolve(frame: DataFrame, by: Sequence[str], kernel: Sequence[float]) -> DataFrame:
    """Causal convolution, cut to the length of the series."""
    w = Window.partitionBy(*by).orderBy("row_id")
    total = sum((F.coalesce(F.lag("value", k).over(w), F.lit(0.0)) * weight for k, weight in enumerate(kernel)), F.lit(0.0))
    return frame.withColumn("value", total)


def add_poly(frame: DataFrame, by: Sequence[str], order: int) -> DataFrame:
    """Columns poly_0 to poly_order: Legendre polynomials over the rows from -1 to 1."""
    joined = _group_stats(frame, by, n_=F.count(F.lit(1)))
    x = F.when(F.col("n_") > 1, F.col("row_id") * 2.0 / F.when(F.col("n_") > 1, F.col("n_") - 1) - 1).otherwise(F.lit(-1.0))
    return joined.withColumns({f"poly_{k}": p for k, p in enumerate(legendre(x, order))}).drop("n_")


def cosine_order(n: int, tr: float, duration: float) -> int:
    """How many cosines a high-pass filter of this duration has, the constant left out."""
    return max(0, math.trunc(2 * n * tr / duration + 1) - 1)


def add_cosines(frame: DataFrame, by: Sequence[str], order: int) -> DataFrame:
    """Columns cosine_1 to cosine_order: cos(pi (2 t + 1) i / (2 n)) over the first basis value at t = 0."""
    joined = _group_stats(frame, by, n_=F.count(F.lit(1)))

    def basis(i: int, t: Column) -> Column:
        return F.cos(F.lit(math.pi) * (2 * t + 1) * i / (2 * F.col("n_")))

    first = basis(1, F.lit(0.0))
    return joined.withColumns({f"cosine_{i}": basis(i, F.col("row_id")) / first for i in range(1, order + 1)}).drop("n_")


def boxcar(events: DataFrame, n_rows: int, sampling_freq: float, kinds: Sequence[str]) -> DataFrame:
    """Event intervals (onset, duration, kind, in seconds) to regressors: row_id and a column a kind.

    Each interval makes its own frames onset <= t < onset + duration, so this is no range join.
    """
    first = F.ceil(F.col("onset") * sampling_freq).cast("long")
    last = (F.ceil((F.col("onset") + F.col("duration")) * sampling_freq) - 1).cast("long")
    lo, hi = F.greatest(first, F.lit(0)), F.least(last, F.lit(n_rows - 1))
    frames = events.filter(lo <= hi).select("kind", F.explode(F.sequence(lo, hi)).alias("row_id"))
    wide = frames.groupBy("row_id").pivot("kind", list(kinds)).agg(F.count(F.lit(1)))
    rows = events.sparkSession.range(n_rows).withColumnRenamed("id", "row_id")
    return rows.join(wide, "row_id", "left").select("row_id", *[F.coalesce(F.col(k), F.lit(0)).cast("double").alias(k) for k in kinds])


def phase_summary(frame: DataFrame, by: Sequence[str], angle: str) -> DataFrame:
    """by..., n, mean_angle, vector_length and Rayleigh's p, with its series for n <= 50."""
    s = frame.groupBy(*by).agg(F.count(angle).alias("n"), F.avg(F.sin(angle)).alias("s"), F.avg(F.cos(angle)).alias("c"))
    r, n = F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")), F.col("n")
    z = n * r * r
    short = F.exp(-z) * (1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * z * z * z - 9 * z * z * z * z) / (288 * n * n))
    return s.select(
        *by, "n", F.atan2("s", "c").alias("mean_angle"), r.alias("vector_length"), F.when(n <= 50, short).otherwise(F.exp(-z)).alias("p")
    )


# stacking designs

Separated = tuple[DataFrame, list[str]]


def matches(name: str, pattern: str) -> bool:
    """A column name against an exact name, prefix* or *suffix."""
    if pattern.endswith("*"):
        return name.startswith(pattern[:-1])
    return name.endswith(pattern[1:]) if pattern.startswith("*") else name == pattern


def append_horizontal(first: DataFrame, second: DataFrame, key: str = "row_id", fill: float = 0.0) -> DataFrame:
    """Columns side by side on the row id; doubled names are an error; gaps are filled."""
    doubled = set(first.columns) & set(second.columns) - {key}
    if doubled:
        raise ValueError(f"columns on both sides: {sorted(doubled)}")
    return first.join(second, key, "full").fillna(fill)


def append_vertical(frames: Sequence[DataFrame], separate: Sequence[str] = (), key: str = "row_id", fill: float = 0.0) -> DataFrame:
    """Runs below each other with a run column; columns that match `separate` become {run}_{name}."""
    out = None
    for run, frame in enumerate(frames):
        own = [F.col(c).alias(f"{run}_{c}" if c != key and any(matches(c, p) for p in separate) else c) for c in frame.columns]
        named = frame.select(F.lit(run).alias("run"), *own)
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out.fillna(fill)


def expand_labels(frame: DataFrame, label: str, labels: Sequence[int]) -> DataFrame:
    """Integer labels to a row for each label and element: one-hot."""
    return frame.withColumn("mask", F.explode(F.array(*[F.lit(k) for k in labels]))).withColumn("value", (F.col(label) == F.col("mask")).cast("int"))


def collapse_masks(masks: DataFrame) -> DataFrame:
    """masks(mask_id, voxel_id, value) to voxel_id, label: the sum of 1-based mask numbers that hold the
    voxel; voxels that all masks hold are left out."""
    total = F.broadcast(masks.agg(F.countDistinct("mask_id").alias("n_masks")))
    held = masks.filter("value <> 0").groupBy("voxel_id").agg(F.sum(F.col("mask_id") + 1).alias("label"), F.count(F.lit(1)).alias("n"))
    return held.join(total).filter("n < n_masks").select("voxel_id", "label")


# haemodynamic responses

#: The double-gamma shapes (peak delay, undershoot delay, their dispersions, undershoot ratio).
RESPONSES = {"spm": (6.0, 16.0, 1.0, 1.0, 1 / 6), "glover": (6.0, 12.0, 0.9, 0.9, 0.48)}


def response_kernel(tr: float, model: str = "glover", oversampling: int = 16, length: float = 32.0) -> list[float]:
    """The response to a brief event, sampled at tr / oversampling and normalised to sum 1 there, then
    averaged over each tr: weights of this row, the row before, and so on."""
    delay, under, dispersion, under_dispersion, ratio = RESPONSES[model]
    step = tr / oversampling

    def gamma(t: float, shape: float, scale: float) -> float:
        return 0.0 if t <= 0 else math.exp((shape - 1) * math.log(t / scale) - t / scale - math.lgamma(shape)) / scale

    fine = [
        gamma(k * step, delay / dispersion, dispersion) - ratio * gamma(k * step, under / under_dispersion, under_dispersion)
        for k in range(int(length / step))
    ]
    total = sum(fine)
    return [sum(fine[k : k + oversampling]) / total for k in range(0, len(fine), oversampling)]


def beats_per_minute(sampling_freq: float, interval: Column) -> Column:
    return F.lit(60.0 * sampling_freq) / interval
