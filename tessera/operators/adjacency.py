"""Arithmetic, resampling tests and round robins of stacks of matrices: adj(matrix_id, i, j, value), a row an edge.

As for the reducers of `matrices`, null and NaN edges are missing: they are in no sum and no count, and an edge that is
missing in all matrices has no row in a result. An edge that is given twice in a matrix counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import safe_div
from tessera.functions.distributions import p_of_t
from tessera.operators.inference import Signs, bootstrap_weights, random_signs
from tessera.operators.matrices import social_relations
from tessera.operators.resampling import _STATISTICS, _described
from tessera.sources.scratch import keep

#: Bytes of weights (rows x replicates) that a task makes at a time.
WEIGHT_BYTES = 32 << 20
#: Replicates in a row of partial results.
WIDTH = 16

_OPS = {
    "add": lambda x, y: x + y,
    "sub": lambda x, y: x - y,
    "mul": lambda x, y: x * y,
    "div": lambda x, y: F.try_divide(x, y),
}


def arithmetic(adj: DataFrame, op: str, other: float, reverse: bool = False) -> DataFrame:
    """value op other, or other op value with `reverse`; a division by zero is null."""
    x, y = F.col("value"), F.lit(float(other))
    return adj.withColumn("value", _OPS[op](y, x) if reverse else _OPS[op](x, y))


def arithmetic_matrices(first: DataFrame, second: DataFrame, op: str) -> DataFrame:
    """Edge by edge over the matrices of one id; an edge that only one side has is null, as is a division by zero."""
    other = second.select("matrix_id", "i", "j", F.col("value").alias("other"))
    both = first.select("matrix_id", "i", "j", "value").join(other, ["matrix_id", "i", "j"], "full")
    return both.select("matrix_id", "i", "j", _OPS[op](F.col("value"), F.col("other")).alias("value"))


def _edge_replicates(adj: DataFrame, replicates: int, weigh: Signs, parts: dict, merged: dict[str, str]) -> DataFrame:
    """i, j, block, a column of WIDTH replicates for each part: what all matrices give for an edge in each replicate.

    parts(name -> function of weights (replicates x rows), values and the starts of the edges among the rows, to
    replicates x edges) say what a task makes of sorted rows; merged(name -> sum, min, max) how tasks' results meet.
    Edges are sorted over range partitions that may split an edge, so an edge of any number of matrices is many
    tasks' work, and a task gives a row for each of its edges and block of replicates, not for each matrix.
    """
    blocks = -(-(replicates + 1) // WIDTH)
    numbers = np.arange(blocks * WIDTH)
    step = max(1, WEIGHT_BYTES // (8 * len(numbers)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), step):
                rows = batch.iloc[at : at + step]
                i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
                starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
                weights = weigh(rows["number"].to_numpy(), numbers)
                made = {name: part(weights, rows["value"].to_numpy(), starts) for name, part in parts.items()}
                for block in range(blocks):
                    held = {name: list(m[block * WIDTH : (block + 1) * WIDTH].T) for name, m in made.items()}
                    yield pd.DataFrame({"i": i[starts], "j": j[starts], "block": block, **held})

    kinds = dict(adj.dtypes)
    number = F.col("matrix_id").cast("long") if kinds["matrix_id"] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("matrix_id")
    there = adj.filter("value IS NOT NULL AND NOT isnan(value)").select("i", "j", number.alias("number"), F.col("value").cast("double").alias("value"))
    ordered = there.repartitionByRange("i", "j", "number").sortWithinPartitions("i", "j", "number")
    schema = f"i {kinds['i']}, j {kinds['j']}, block int, " + ", ".join(f"{name} array<double>" for name in parts)
    meet = {"sum": F.sum, "min": F.min, "max": F.max}
    columns = [F.array(*[meet[merged[name]](F.get(name, F.lit(k))) for k in range(WIDTH)]).alias(name) for name in parts]
    return ordered.mapInPandas(run, schema).groupBy("i", "j", "block").agg(*columns)


#: Rows of one edge in a piece of its order.
PIECE = 4096


def _edge_medians(adj: DataFrame, replicates: int, weigh: Signs) -> DataFrame:
    """i, j, block, v: the medians of an edge's values in WIDTH replicates, each value counted as often as it is drawn; null
    where none is.

    Values are sorted over range partitions that may split an edge and saved as pieces of PIECE rows at most. The first pass
    counts what is drawn of each piece; counts before a piece say in which one the middle lies (two where the middle is
    between two values), and the second pass looks it up there. No task holds an edge, and none has more than its pieces.
    """
    kinds = dict(adj.dtypes)
    number = F.col("matrix_id").cast("long") if kinds["matrix_id"] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("matrix_id")
    there = adj.filter("value IS NOT NULL AND NOT isnan(value)").select("i", "j", number.alias("number"), F.col("value").cast("double").alias("value"))
    ordered = there.repartitionByRange("i", "j", "value", "number").sortWithinPartitions("i", "j", "value", "number").withColumn("part", F.spark_partition_id())
    edge = f"i {kinds['i']}, j {kinds['j']}"
    blocks = -(-(replicates + 1) // WIDTH)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq = 0
        for batch in batches:
            i, j = batch["i"].to_numpy(), batch["j"].to_numpy()
            ends = np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            edges = [0, *ends, len(batch)]
            cuts = [(a, min(a + PIECE, z)) for lo, z in zip(edges[:-1], edges[1:], strict=True) for a in range(lo, z, PIECE)]
            n, v = batch["number"].to_numpy(), batch["value"].to_numpy()
            at = [a for a, _ in cuts]
            held = {"numbers": [n[a:z] for a, z in cuts], "held": [v[a:z] for a, z in cuts]}
            yield pd.DataFrame({"i": i[at], "j": j[at], "part": batch["part"].to_numpy()[at], "seq": np.arange(seq, seq + len(cuts)), **held})
            seq += len(cuts)

    pieces = keep(ordered.mapInPandas(cut, f"{edge}, part int, seq long, numbers array<long>, held array<double>"), "medians")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                drawn = weigh(np.asarray(row.numbers), np.arange(blocks * WIDTH)).sum(axis=1).reshape(blocks, WIDTH)
                yield pd.DataFrame({"i": row.i, "j": row.j, "part": row.part, "seq": row.seq, "block": np.arange(blocks), "w": list(drawn)})

    counts = pieces.select("i", "j", "part", "seq", "numbers").mapInPandas(count, f"{edge}, part int, seq long, block int, w array<double>")
    own = Window.partitionBy("i", "j", "block")
    earlier = own.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    each = [F.get("w", F.lit(k)) for k in range(WIDTH)]
    sums = counts.select("*", F.array(*[F.coalesce(F.sum(w).over(earlier), F.lit(0.0)) for w in each]).alias("before"), F.array(*[F.sum(w).over(own) for w in each]).alias("total"))
    asked = sums.groupBy("i", "j", "part", "seq").agg(F.collect_list(F.struct("block", "before", "total")).alias("asked"))  # an entry a block

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                values, found = np.asarray(row.held), []
                for of in row.asked:
                    before, total = np.asarray(of["before"]), np.asarray(of["total"])
                    weights = weigh(np.asarray(row.numbers), np.arange(of["block"] * WIDTH, (of["block"] + 1) * WIDTH))
                    after = np.cumsum(weights, axis=1)
                    half = np.full(WIDTH, np.nan)
                    for k in np.flatnonzero(total > 0):
                        for middle in ((total[k] - 1) // 2, total[k] // 2):
                            place = middle - before[k]
                            if 0 <= place < after[k, -1]:
                                half[k] = np.nan_to_num(half[k]) + values[np.searchsorted(after[k], place, side="right")] / 2
                    found.append((row.i, row.j, of["block"], [None if np.isnan(h) else h for h in half]))
                yield pd.DataFrame(found, columns=["i", "j", "block", "v"])

    met = pieces.join(asked, ["i", "j", "part", "seq"]).mapInPandas(pick, f"{edge}, block int, v array<double>")
    return met.groupBy("i", "j", "block").agg(F.array(*[F.sum(F.get("v", F.lit(k))) for k in range(WIDTH)]).alias("v"))


def _per_edge(blocks: DataFrame, made: Column, replicates: int) -> DataFrame:
    """i, j, drawn: the array of all replicates of an edge, 0 first."""
    one = blocks.select("i", "j", "block", made.alias("made")).groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("block", "made"))).alias("all"))
    return one.select("i", "j", F.slice(F.flatten(F.transform("all", lambda b: b["made"])), 1, replicates + 1).alias("drawn"))


def _weighted(weights: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights * values, starts, axis=1)


def _counted(weights: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights, starts, axis=1)


def _squared(weights: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights * values**2, starts, axis=1)


def _least(weights: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(np.where(weights > 0, values, np.inf), starts, axis=1)


def _greatest(weights: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(np.where(weights > 0, values, -np.inf), starts, axis=1)


def edge_permutation(adj: DataFrame, replicates: int = 5000, signs: Signs | None = None, tail: str = "two") -> DataFrame:
    """i, j, n, stat (the mean over n matrices), p = (replicates at least as extreme + 1) / (replicates + 1) under sign
    flips of matrices; a flip is the same for all edges of a matrix. tail: two, upper or lower; values equal up to
    rounding count as extreme. An edge of one matrix has p = 1 in the two-sided test. No matrices: no rows.
    """
    beyond = {
        "two": lambda x, o: F.abs(x) >= F.abs(o) - 1e-12,
        "upper": lambda x, o: x >= o - 1e-12,
        "lower": lambda x, o: x <= o + 1e-12,
    }[tail]
    ones = lambda w, v, starts: np.add.reduceat(np.ones_like(w), starts, axis=1)
    blocks = _edge_replicates(adj, replicates, signs or random_signs(), {"total": _weighted, "n": ones}, {"total": "sum", "n": "sum"})
    counts = blocks.filter("block = 0").select("i", "j", F.get("n", F.lit(0)).cast("long").alias("n"))
    means = _per_edge(blocks, F.zip_with("total", "n", lambda t, n: t / n), replicates).join(counts, ["i", "j"])
    own = F.get("drawn", F.lit(0))
    extreme = F.size(F.filter(F.slice("drawn", 2, max(1, replicates)), lambda x: beyond(x, own)))
    return means.select("i", "j", "n", own.alias("stat"), ((extreme + 1) / F.lit(replicates + 1)).alias("p"))


def edge_bootstrap(adj: DataFrame, how: str = "mean", replicates: int = 5000, weigh: Signs | None = None, percentiles: tuple[float, float] = (2.5, 97.5)) -> DataFrame:
    """i, j, stat (of the data), mean, std, z, p, lo, hi of an edge's mean, median, sum, std (population), min or max over
    matrices that are drawn again; a draw is the same for all edges. The median's result reads a saved table (`keep`).

    Replicates are Poisson counts by hashes of matrix_id. One in which an edge has no matrix is left out of that edge's
    mean, std and percentiles; an edge that no replicate has gets nulls, and std is 0 where one replicate has it.
    """
    weights = weigh or bootstrap_weights()
    if how in ("mean", "sum", "std"):
        parts = {"w": _counted, "t": _weighted} | ({"s": _squared} if how == "std" else {})
        blocks = _edge_replicates(adj, replicates, weights, parts, dict.fromkeys(parts, "sum"))
        none = F.lit(None).cast("double")
        made = F.zip_with("t", "w", lambda t, w: F.when(w > 0, t / w if how != "sum" else t).otherwise(none))
        if how == "std":
            square = F.zip_with("s", "w", lambda s, w: F.when(w > 0, s / w).otherwise(none))
            made = F.zip_with(made, square, lambda m, s: F.sqrt(F.greatest(s - m * m, F.lit(0.0))))
            made = F.zip_with(made, "w", lambda v, w: F.when(w > 0, v).otherwise(none))
    elif how in ("min", "max"):
        blocks = _edge_replicates(adj, replicates, weights, {"v": _least if how == "min" else _greatest}, {"v": how})
        made = F.transform("v", lambda x: F.when(F.abs(x) < float("inf"), x))
    elif how == "median":
        blocks, made = _edge_medians(adj, replicates, weights), F.col("v")
    else:
        raise ValueError(f"{how} is none of mean, median, sum, std, min, max")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for drawn in batch["drawn"]:
                all_drawn = np.array([np.nan if x is None else x for x in drawn], float)
                kept = all_drawn[1:][~np.isnan(all_drawn[1:])]
                told = _described(kept, percentiles) if len(kept) else [np.nan] * len(_STATISTICS)
                rows.append([float(s) for s in (all_drawn[0], *told)])
            named = pd.DataFrame(np.array(rows).reshape(-1, 1 + len(_STATISTICS)), columns=["stat", *_STATISTICS])
            yield pd.concat([batch[["i", "j"]].reset_index(drop=True), named], axis=1)

    kinds = dict(adj.dtypes)
    schema = f"i {kinds['i']}, j {kinds['j']}, " + ", ".join(f"{s} double" for s in ["stat", *_STATISTICS])
    return _per_edge(blocks, made, replicates).mapInPandas(describe, schema)


def relation_shares(square: DataFrame) -> DataFrame:
    """social_relations with the total variance, the correlations behind its covariances and the reliabilities of
    actors and partners (of a mean over n - 1 others). Null where a variance below 0 leaves a root undefined."""
    n, none = F.col("n"), None
    actor, partner, rel, dyad = (F.col(c) for c in ("actor", "partner", "relationship", "dyad"))
    noise = rel / (n - 1) - dyad / ((n - 1) * (n - 1))
    product = actor * partner
    made = social_relations(square).withColumns(
        {
            "total": actor + partner + rel,
            "actor_partner_r": F.when(product > 0, safe_div(F.col("actor_partner"), F.sqrt(F.abs(product)), none)),
            "dyad_r": safe_div(dyad, rel, none),
            "actor_reliability": safe_div(actor, actor + noise, none),
            "partner_reliability": safe_div(partner, partner + noise, none),
        }
    )
    both = F.col("actor_reliability") * F.col("partner_reliability")
    return made.withColumn("adjusted_dyad_r", F.when(both >= 0, F.col("actor_partner_r") * F.sqrt(F.abs(both))))


def summarize_relations(shares: DataFrame) -> DataFrame:
    """component, n, estimate, standardized, se, t, p over the groups of relation_shares: variances (standardised by
    the total, one-sided) and covariances (with the mean correlation, two-sided). se, t and p are null for one group."""
    kept = ["actor", "partner", "relationship", "actor_partner", "dyad"]
    scaled = {c: safe_div(F.col(c), F.col("total"), None) for c in kept[:3]} | {c: F.col(f"{c}_r") for c in kept[3:]}
    each = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("x"), scaled[c].alias("y"), F.lit(c in kept[:3]).alias("upper")) for c in kept])
    s = shares.select(F.explode(each).alias("e")).select("e.*").groupBy("component", "upper").agg(
        F.count("x").alias("n"), F.avg("x").alias("estimate"), F.avg("y").alias("standardized"), (F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("se")
    )
    s = s.withColumn("t", F.when(F.col("n") > 1, safe_div(F.col("estimate"), F.col("se"), None)))
    two = F.when(F.col("t").isNotNull(), p_of_t(F.col("t"), F.greatest(F.col("n") - 1, F.lit(1)).cast("double")))
    p = F.when(~F.col("upper"), F.col("two")).when(F.col("t") > 0, F.col("two") / 2).otherwise(1 - F.col("two") / 2)
    return s.withColumn("two", two).select("component", "n", "estimate", "standardized", F.when(F.col("n") > 1, F.col("se")).alias("se"), "t", p.alias("p"))
