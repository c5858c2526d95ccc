"""Confounds of many runs: columns by strategy, samples that are censored, and what stays as regressors.

values(path, row_id, values): a row a sample of a run, values a map of column names to doubles, as `sources.files.read_runs`
gives it. Runs may have unlike columns. All is column expressions and windows inside a run; order is row_id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of columns by strategy and level, as preprocessing pipelines write them.
_AXES = r"(trans|rot)_[xyz]"
_TISSUE = r"(csf|white_matter)"
_GLOBAL = r"global_signal"
_LEVELS = {"basic": "", "power2": r"(_power2)?", "derivatives": r"(_derivative1)?", "full": r"(_derivative1)?(_power2)?"}
STRATEGIES = {"motion": _AXES, "wm_csf": _TISSUE, "global_signal": _GLOBAL, "high_pass": r"cosine\d+", "compcor": r"[atc]_comp_cor_\d+"}
NON_STEADY = r"non_steady_state_outlier\d+"
DISPLACEMENT, VARIANCE = "framewise_displacement", "std_dvars"


def _pattern(strategy: str, level: str) -> str:
    if strategy not in STRATEGIES:
        raise ValueError(f"{strategy!r} is none of {sorted(STRATEGIES)}")
    if strategy in ("high_pass", "compcor"):
        return f"^{STRATEGIES[strategy]}$"
    if level not in _LEVELS:
        raise ValueError(f"{level!r} is none of {sorted(_LEVELS)}")
    return f"^{STRATEGIES[strategy]}{_LEVELS[level]}$"


def censor(frame: DataFrame, by: Sequence[str], order: str, bad: Column, least: int = 5) -> DataFrame:
    """frame with the boolean `kept`: rows that are not bad, in stretches of `least` consecutive such rows or more.

    bad null is not bad. A stretch is of rows in order, whatever their distance; rows of one place in the order are
    an undefined order. least 0 or 1 keeps every row that is not bad.
    """
    run = Window.partitionBy(*by)
    flagged = frame.withColumn("bad_", F.coalesce(bad, F.lit(False)))
    numbered = flagged.withColumn("stretch_", F.sum(F.col("bad_").cast("int")).over(run.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    long_enough = F.count(F.when(~F.col("bad_"), 1)).over(Window.partitionBy(*by, "stretch_")) >= least
    return numbered.withColumn("kept", ~F.col("bad_") & long_enough).drop("bad_", "stretch_")


def sample_masks(values: DataFrame, displacement: float | None = 0.5, variance: float | None = 1.5, least: int = 5) -> DataFrame:
    """values with `kept`: samples whose framewise displacement and standardised DVARS are not above the limits (null: no
    limit), that are not in the steady state's onset, and whose stretch has `least` samples; a missing measure is not above.
    """
    never = F.lit(False)
    moved = F.col("values")[DISPLACEMENT] > displacement if displacement is not None else never
    jumped = F.col("values")[VARIANCE] > variance if variance is not None else never
    onset = F.exists(F.map_entries("values"), lambda e: e["key"].rlike(f"^{NON_STEADY}$") & (F.coalesce(e["value"], F.lit(0.0)) != 0))
    motion = F.coalesce(moved, never) | F.coalesce(jumped, never)
    return censor(values, ["path"], "row_id", motion, least).withColumn("kept", F.col("kept") & ~F.coalesce(onset, never))


def missing_strategies(values: DataFrame, strategies: Mapping[str, str]) -> DataFrame:
    """path, strategy: the strategies of which a run has no column."""
    runs = values.groupBy("path").agg(F.array_distinct(F.flatten(F.collect_set(F.map_keys("values")))).alias("names"))  # runs have few sets of names

    def there(pattern: str) -> Column:
        return F.exists("names", lambda n: n.rlike(pattern))

    each = F.array(*[F.struct(F.lit(s).alias("strategy"), there(_pattern(s, v)).alias("there")) for s, v in strategies.items()])
    return runs.select("path", F.explode(each).alias("e")).filter("NOT e.there").select("path", "e.strategy")


def select_confounds(masked: DataFrame, strategies: Mapping[str, str], demean: bool = True) -> DataFrame:
    """path, row_id, kept, values: of each sample the columns of the strategies ({"motion": "full", ...}) alone.

    Levels are basic, power2, derivatives or full; high_pass and compcor have none. With `demean` each column of a run is
    less its mean over kept samples, and a missing value is that mean, so 0; without, a missing value stays null. Columns that
    a run does not have are not in its maps; a column without any value over kept samples is null. `masked` is of
    sample_masks, or any table with `kept`.
    """
    patterns = [_pattern(s, v) for s, v in strategies.items()]

    def wanted(name: Column, _value: Column) -> Column:
        found = F.lit(False)
        for p in patterns:
            found = found | name.rlike(p)
        return found

    chosen = masked.select("path", "row_id", "kept", F.map_filter("values", wanted).alias("values"))
    if not demean:
        return chosen
    cells = chosen.filter("kept").select("path", F.explode("values").alias("name", "x"))
    means = cells.groupBy("path", "name").agg(F.avg("x").alias("m"))
    means = means.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "m"))).alias("means"))  # a number a column
    less = F.transform_values("values", lambda k, x: F.when(F.try_element_at("means", k).isNotNull(), F.coalesce(x - F.try_element_at("means", k), F.lit(0.0))))
    return chosen.join(means, "path", "left").select("path", "row_id", "kept", F.when(F.col("means").isNull(), F.transform_values("values", lambda k, x: F.lit(None).cast("double"))).otherwise(less).alias("values"))
