"""Ranks, rank and product correlations, corrections for many tests, folds and ROC curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import corr_of_moments, moments, safe_div
from tessera.operators.sizes import sent
from tessera.sources.scratch import keep


def ordered_places(frame: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "place", total: str | None = None) -> DataFrame:
    """frame with each row's place from 1 in `order` within `by`, and the rows of its `by` as `total` if that is named.

    Rows are range partitioned by both and sorted in their tasks, so a group of any size is many tasks; a row's place is its place in its
    part of the group plus the rows of the parts before, whose counts are a row a part and group. Nulls come first; equal
    rows have neighbouring places in any order. The rows are saved once, for parts to be the same for both.
    """
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    rows = keep(dealt.withColumn("at_", F.monotonically_increasing_id()), "places").withColumn("part_", F.shiftright("at_", 33))
    counts = rows.groupBy("part_", *by).agg(F.min("at_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    whole = Window.partitionBy(*by)  # a row a part
    before = F.sum("n_").over(whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_")
    parts = counts.select(F.col("part_").alias("part_2"), *[F.col(c).alias(f"{c}_2") for c in by], (before - F.col("first_") + 1).alias("add_"), F.sum("n_").over(whole).alias("all_"))
    on = F.col("part_") == F.col("part_2")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_2"))
    met = rows.join(parts, on).withColumn(out, F.col("at_") + F.col("add_"))
    return met.select(*frame.columns, out, *([F.col("all_").alias(total)] if total else []))


def average_ranks(frame: DataFrame, column: str, by: Sequence[str], out: str) -> DataFrame:
    """Ranks from 1, ties at their mean: counts of each distinct value, summed in order, joined back.

    The window runs over distinct values, which are already counted, not over rows.
    """
    counts = frame.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n_")).filter(F.col(column).isNotNull())
    below = F.sum("n_").over(Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = counts.withColumn(out, below - (F.col("n_") - 1) / 2).drop("n_")
    return frame.join(ranks, [*by, column], "left")


def pearson(frame: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """by..., n, r; r is 0 where a side is constant. One aggregation of moments."""
    return frame.groupBy(*by).agg(*moments(x, y)).select(*by, F.col("n").cast("long").alias("n"), corr_of_moments().alias("r"))


def spearman(frame: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    both = frame.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(both, x, by, "rx_"), y, by, "ry_")
    return pearson(ranked, "rx_", "ry_", by)


def total_before(frame: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """frame with the sum of `value` over the rows before each one in `order` within `by` (0 for the first), as a long.

    As `ordered_places`: range partitions may split a group; sums inside a part of it are added to those of the parts before.
    Rows of one place in the order are an undefined order. The rows are saved once.
    """
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keep(frame.repartitionByRange(n, *by, *order).withColumn("part_", F.spark_partition_id()), "totals")
    counts = rows.groupBy("part_", *by).agg(F.sum(value).alias("n_"))
    earlier = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts = counts.select(F.col("part_").alias("part_2"), *[F.col(c).alias(f"{c}_2") for c in by], F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("add_"))
    inside = Window.partitionBy("part_", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = F.col("part_") == F.col("part_2")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_2"))
    summed = rows.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(parts, on).select(*frame.columns, (F.col(out) + F.col("add_")).cast("long").alias(out))


def kendall(frame: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """by..., tau-b of all pairs of a group's rows; 0 where a side is constant. Groups of one row, and null groups, have no row.

    Discordant pairs are counted, not made: y's rank as a binary number, two rows differ first at one level of its
    digits, so at each level the rows of one prefix, in the order of x, count the ones before each zero. That is
    n log n rows for n, in range partitions that may split a group. Null and NaN pairs of values take no part.
    """
    if not by:
        return kendall(frame.withColumn("whole_", F.lit(0)), x, y, ["whole_"]).drop("whole_")
    both = frame.select(*by, F.col(x).alias("x_"), F.col(y).alias("y_")).dropna()
    both = keep(both, "kendall")
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    n = F.col("n_")
    cells = both.groupBy(*by, "x_", "y_").agg(F.count(F.lit(1)).alias("n_"))
    tied = cells.groupBy(*by).agg(F.sum("n_").alias("n"), pairs(n).alias("xy"))
    for side in ("x_", "y_"):
        own = cells.groupBy(*by, side).agg(F.sum("n_").alias("n_")).groupBy(*by).agg(pairs(n).alias(f"t{side}"))
        tied = tied.join(own, list(by))
    ranks = ordered_places(cells.select(*by, "y_").distinct(), by, ["y_"], "rank_", "values_")
    # levels of digits from the lowest to that of the group's number of values
    digits = F.explode(F.sequence(F.lit(0), F.length(F.bin("values_")) - 1))
    placed = cells.join(ranks, [*by, "y_"]).select(*by, "x_", "n_", "rank_", digits.alias("level_"))
    prefix, bit = F.expr("shiftright(rank_, level_ + 1)"), F.expr("shiftright(rank_, level_) & 1")
    spread = placed.select(*by, "x_", "n_", "level_", prefix.alias("prefix_"), bit.alias("bit_"))
    levels = spread.groupBy(*by, "level_", "prefix_", "x_").agg(F.sum(F.col("n_") * F.col("bit_")).alias("ones_"), F.sum(F.col("n_") * (1 - F.col("bit_"))).alias("zeros_"))
    crossed = total_before(levels, [*by, "level_", "prefix_"], ["x_"], "ones_", "before_").groupBy(*by).agg(F.sum(F.col("before_") * F.col("zeros_")).alias("d"))
    all_ = F.col("n") * (F.col("n") - 1) / 2
    s = all_ - F.col("tx_") - F.col("ty_") + F.col("xy") - 2 * F.col("d")
    made = tied.filter("n > 1").join(crossed, list(by))
    return made.select(*by, safe_div(s, F.sqrt((all_ - F.col("tx_")) * (all_ - F.col("ty_")))).alias("tau"))


def _by_rank(frame: DataFrame, p: str, by: Sequence[str]) -> DataFrame:
    """frame's rows with a p, its rank `i` from 1 and their number `n` within by."""
    return ordered_places(frame.filter(F.col(p).isNotNull()).select(*by, p), by, [p], "i", "n")


def fdr_threshold(frame: DataFrame, p: str, q: float, by: Sequence[str]) -> DataFrame:
    """by..., threshold: Benjamini and Hochberg's largest p at or under rank * q / n, else -1."""
    ranked = _by_rank(frame, p, by)
    return ranked.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col(p) <= F.col("i") * q / F.col("n"), F.col(p))), F.lit(-1.0)).alias("threshold"))


def holm_threshold(frame: DataFrame, p: str, alpha: float, by: Sequence[str]) -> DataFrame:
    """by..., threshold: the largest p at or under alpha / (n - rank + 1) (step-up), else -1."""
    passed = F.when(F.col(p) <= alpha / (F.col("n") - F.col("i") + 1), F.col(p))
    return _by_rank(frame, p, by).groupBy(*by).agg(F.coalesce(F.max(passed), F.lit(-1.0)).alias("threshold"))


def stratified_folds(frame: DataFrame, y: str, key: str, k: int, by: Sequence[str]) -> DataFrame:
    """fold: sorted ranks of y dealt round to k folds, ties by key."""
    placed = ordered_places(frame, by, [y, key], "place_")
    return placed.withColumn("fold", F.pmod(F.col("place_") - 1, F.lit(k)).cast("long")).drop("place_")


def contiguous_folds(frame: DataFrame, key: str, k: int, by: Sequence[str]) -> DataFrame:
    """fold: k runs in the order of key, the first n % k of them one longer."""
    placed = ordered_places(frame, by, [key], "place_", "n_all_")
    at, short = F.col("place_") - 1, F.floor(F.col("n_all_") / k)
    long_ones = (F.col("n_all_") % k) * (short + 1)  # rows of the runs that are one longer
    fold = F.when(at < long_ones, F.floor(at / (short + 1))).otherwise(F.col("n_all_") % k + F.floor((at - long_ones) / F.greatest(short, F.lit(1))))
    return placed.withColumn("fold", fold.cast("long")).drop("place_", "n_all_")


def group_folds(frame: DataFrame, group: str) -> DataFrame:
    """fold: one for each group, in order."""
    groups = frame.select(group).distinct().withColumn("fold", (F.dense_rank().over(Window.orderBy(group)) - 1).cast("long"))
    return frame.join(sent(groups), group)


def roc_points(frame: DataFrame, score: str, positive: str, by: Sequence[str]) -> DataFrame:
    """by..., score, tpr, fpr: of the rule "score or more", at each distinct score.

    Counts by score come first, so the window runs over distinct scores.
    """
    pos = F.col(positive).cast("long")
    counts = frame.groupBy(*by, score).agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("n"))
    up = Window.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    run = counts.select(
        *by, score, F.sum("p").over(up).alias("tp"), F.sum("n").over(up).alias("fp"), F.sum("p").over(whole).alias("tot_p"), F.sum("n").over(whole).alias("tot_n")
    )
    return run.select(*by, score, safe_div(F.col("tp"), F.col("tot_p"), None).alias("tpr"), safe_div(F.col("fp"), F.col("tot_n"), None).alias("fpr"))


def auc(points: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    """by..., auc: the trapezoid area under roc_points, from (0, 0)."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc())
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0.0))
    steps = points.withColumn("area", (F.col("fpr") - before("fpr")) * (F.col("tpr") + before("tpr")) / 2)
    return steps.groupBy(*by).agg(F.sum("area").alias("auc"))


def best_threshold(points: DataFrame, score: str, by: Sequence[str], how: str = "balanced") -> DataFrame:
    """by..., threshold, tpr, fpr: balanced maximises tpr - fpr; sdt_bias minimises the distance of the
    rates' sum from 1, signal detection's point without bias. Ties to the higher score."""
    gain = F.col("tpr") - F.col("fpr") if how == "balanced" else -F.abs(F.col("tpr") + F.col("fpr") - 1)
    best = points.groupBy(*by).agg(F.max(F.struct(F.round(gain, 12), F.col(score), "tpr", "fpr")).alias("b"))
    return best.select(*by, F.col(f"b.{score}").alias("threshold"), F.col("b.tpr").alias("tpr"), F.col("b.fpr").alias("fpr"))
