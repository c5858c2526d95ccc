"""Bootstraps whose replicates are weights or multiplicities: correlations of pairs of subjects, ridge models.

A replicate of subjects is how often each was drawn, and a pair of different subjects counts as often as the product; a
subject's pairs with itself count for nothing. So a replicate's median is a weighted median of the pairs as they are. A
replicate of samples is a Poisson count of each, a hash of seed, replicate and id; the products of all replicates
are one matrix product a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.distributions import norm_sf
from tessera.operators.inference import Signs, _hash, bootstrap_weights
from tessera.operators.sums import sum_arrays_by

#: (number of subjects, replicate numbers) to the places of the subjects drawn, a row a replicate.
Draws = Callable[[int, np.ndarray], np.ndarray]
#: Weights (replicates x pairs) that a task holds at a time, and products of all replicates for a block of voxels.
HELD_BYTES, BLOCK_BYTES = 64 << 20, 16 << 20
#: Rows asked for that a task holds, predictions (replicates x rows x voxels) that it makes at a time, and tasks at most.
SHARE_ROWS, TILE_VALUES, MOST_TASKS = 1 << 13, 1 << 20, 2048


def random_draws(seed: int = 0) -> Draws:
    def draws(n: int, replicates: np.ndarray) -> np.ndarray:
        return (_hash(np.arange(n), replicates, seed) % np.uint64(n)).astype(np.int64)

    return draws


def multiplicities(n: int, replicates: np.ndarray, draws: Draws) -> np.ndarray:
    """How often each of n subjects is in each replicate."""
    out = np.zeros((len(replicates), n))
    np.add.at(out, (np.arange(len(replicates))[:, None], draws(n, replicates)), 1.0)
    return out


def weighted_medians(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The median of values, each as often as its whole weight says, of each row of weights; NaN without weight."""
    order = np.argsort(values, kind="stable")
    held = values[order]
    upto = np.cumsum(weights[:, order], axis=1)
    total = upto[:, -1]
    # the middle value, or the mean of the two middle ones
    low, high = (np.array([np.searchsorted(u, p, "right") for u, p in zip(upto, at, strict=True)]) for at in ((total - 1) // 2, total // 2))
    last = len(values) - 1
    return np.where(total > 0, (held[np.minimum(low, last)] + held[np.minimum(high, last)]) / 2, np.nan)


def pair_summaries(r: np.ndarray, first: np.ndarray, second: np.ndarray, n: int, replicates: np.ndarray, draws: Draws, how: str, clip: float = 0.9999) -> np.ndarray:
    """The summary ("median", or "mean" through Fisher's z) of the pairs' correlations in each replicate."""
    out = []
    step = max(1, HELD_BYTES // (8 * max(1, len(r))))
    for at in range(0, len(replicates), step):
        drawn = multiplicities(n, replicates[at : at + step], draws)
        weights = drawn[:, first] * drawn[:, second]
        if how == "median":
            out.append(weighted_medians(r, weights))
        else:
            total = weights.sum(axis=1)
            out.append(np.where(total > 0, np.tanh(weights @ np.arctanh(np.clip(r, -clip, clip)) / np.maximum(total, 1e-300)), np.nan))
    return np.concatenate(out)


def _observed(r: np.ndarray, how: str, clip: float = 0.9999) -> float:
    if not len(r):
        return np.nan
    return float(np.median(r)) if how == "median" else float(np.tanh(np.arctanh(np.clip(r, -clip, clip)).mean()))


def _bounds(null: np.ndarray, observed: float) -> tuple[float, float, float]:
    """p of what was observed in the null centred on it, and the percentile interval; NaN replicates left out."""
    null = null[~np.isnan(null)]
    if not len(null) or np.isnan(observed):
        return np.nan, np.nan, np.nan
    p = ((np.abs(null - observed) >= abs(observed) - 1e-12).sum() + 1) / (len(null) + 1)
    lo, hi = np.percentile(null, [2.5, 97.5])
    return float(p), float(lo), float(hi)


def isc_pairwise_bootstrap(rs: DataFrame, replicates: int, how: str = "median", draws: Draws | None = None, subjects: Sequence | None = None) -> DataFrame:
    """voxel_id, isc, p, lo, hi of rs(a, b, voxel_id, r), correlations of pairs of subjects, under resampled subjects.

    `subjects` are all there are (those in rs if not given): a replicate draws as many. The null is the replicates less the observed
    summary, two-sided. Replicates that draw one subject alone count for nothing. Null and NaN correlations are
    left out. A group is a voxel's pairs: its size follows the subjects, not the times or voxels.
    """
    names = sorted({x for row in rs.select("a", "b").distinct().collect() for x in row}) if subjects is None else sorted(subjects)
    draw = draws or random_draws(11)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["r"].notna()]
        place = {s: k for k, s in enumerate(names)}
        first, second = (group[c].map(place).to_numpy(np.int64) for c in ("a", "b"))
        r = group["r"].to_numpy(float)
        observed = _observed(r, how)
        null = pair_summaries(r, first, second, len(names), np.arange(1, replicates + 1), draw, how) if len(r) else np.array([np.nan])
        return pd.DataFrame([(key[0], observed, *_bounds(null, observed))], columns=["voxel_id", "isc", "p", "lo", "hi"])

    return rs.groupBy("voxel_id").applyInPandas(run, f"voxel_id {dict(rs.dtypes)['voxel_id']}, isc double, p double, lo double, hi double")


def isc_group_bootstrap(rs: DataFrame, groups: dict, replicates: int, how: str = "median", draws: Draws | None = None) -> DataFrame:
    """voxel_id, difference, p, lo, hi of the two groups' summaries of pairs within them, each group resampled for itself.

    groups gives each subject's group, two different values; the first in order less the second. Pairs across groups
    count for nothing. Two-sided, the null centred on the observed difference.
    """
    kinds = sorted(set(groups.values()))
    if len(kinds) != 2:
        raise ValueError(f"two groups are compared, not {len(kinds)}")
    names = [sorted(s for s, g in groups.items() if g == kind) for kind in kinds]
    draw = draws or random_draws(13)
    numbers = np.arange(1, replicates + 1)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["r"].notna()]
        own, null = [], []
        for k, members in enumerate(names):
            place = {s: i for i, s in enumerate(members)}
            inside = group[group["a"].isin(place) & group["b"].isin(place)]
            first, second = (inside[c].map(place).to_numpy(np.int64) for c in ("a", "b"))
            r = inside["r"].to_numpy(float)
            own.append(_observed(r, how))
            # the second group's draws are those of other replicates, so that the groups are independent
            null.append(pair_summaries(r, first, second, len(members), numbers + k * replicates, draw, how) if len(r) else np.full(replicates, np.nan))
        difference = own[0] - own[1]
        return pd.DataFrame([(key[0], difference, *_bounds(null[0] - null[1], difference))], columns=["voxel_id", "difference", "p", "lo", "hi"])

    return rs.groupBy("voxel_id").applyInPandas(run, f"voxel_id {dict(rs.dtypes)['voxel_id']}, difference double, p double, lo double, hi double")


def _weighted_products(frame: DataFrame, features: str, k: int, replicates: int, weigh: Signs, key: str, values: str) -> tuple[DataFrame, int]:
    """key (a block of voxels), at, flat: for each replicate, features' and voxels' weighted products (replicates * k rows of
    k + width numbers); and the width. Rows of a block meet in tasks, which add up their own."""
    numbers = np.arange(replicates + 1)
    width = max(1, BLOCK_BYTES // (8 * (replicates + 1) * k) - k)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / width).cast("int")), lambda i: F.slice(values, i * width + 1, width))
    spread = max(1, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = frame.filter(F.size(values) > 0).select(key, features, F.posexplode(cut).alias("block", "part"))
    dealt = blocks.repartition("block", F.pmod(F.hash(key), F.lit(spread))).sortWithinPartitions("block")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, np.ndarray]]:
        now = total = None
        for batch in batches:
            for block, rows in batch.groupby("block", sort=True):
                if block != now:
                    if total is not None:
                        yield now, total.reshape(-1, total.shape[2])
                    now, total = block, None
                for at in range(0, len(rows), 1024):
                    part = rows.iloc[at : at + 1024]
                    x, y = np.stack(part[features].to_list()).astype(float), np.stack(part["part"].to_list()).astype(float)
                    w, both = weigh(part[key].to_numpy(), numbers), np.hstack([x, y])
                    made = np.stack([(w * x[:, j]) @ both for j in range(k)], axis=1)  # replicates x k x (k + width)
                    total = made if total is None else total + made
        if total is not None:
            yield now, total.reshape(-1, total.shape[2])

    return sum_arrays_by(dealt, "int", add, cells=k + width), width


def _solved(r: dict, k: int, replicates: int, alpha: float) -> np.ndarray:
    """Weights (replicates x k x voxels) from a block's products."""
    sums = np.asarray(r["flat"], float).reshape(replicates + 1, k, -1)
    gram = sums[:, :, :k] + alpha * np.eye(k)
    return np.linalg.solve(gram, sums[:, :, k:])


def _described(drawn: np.ndarray, percentiles: tuple[float, float]) -> list[np.ndarray]:
    """mean, std (ddof 1), z, p, lo, hi over replicates (the first axis)."""
    mean, std = drawn.mean(axis=0), drawn.std(axis=0, ddof=1) if len(drawn) > 1 else np.zeros(drawn.shape[1:])
    z = np.divide(mean, std, out=np.zeros_like(mean), where=std > 1e-300)
    lo, hi = np.percentile(drawn, percentiles, axis=0)
    return [mean, std, z, 2 * norm_sf(np.abs(z)), lo, hi]


_STATISTICS = ["mean", "std", "z", "p", "lo", "hi"]


def ridge_weight_bootstrap(
    frame: DataFrame, features: str, k: int, replicates: int, alpha: float = 1.0, weigh: Signs | None = None, percentiles: tuple[float, float] = (2.5, 97.5), key: str = "image_id", values: str = "values"
) -> DataFrame:
    """feature, voxel_id, weight (of the data), mean, std, z, p, lo, hi of ridge weights under resampled samples.

    frame(key, features: an array of k, values: an array of voxels), no intercept. One pass over the rows for all
    replicates: voxels go in blocks whose products for all replicates are about BLOCK_BYTES, partial sums of a block
    meet on the executors, and a block's systems are solved in one task. Replicates are Poisson counts by hashes of the
    key, the same for all voxels. alpha must be above 0. Empty vectors and empty tables: no rows.
    """
    if alpha <= 0:
        raise ValueError("alpha must be above 0, or a replicate may have no solution")
    sums, width = _weighted_products(frame, features, k, replicates, weigh or bootstrap_weights(), key, values)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                w = _solved(r, k, replicates, alpha)
                voxels = w.shape[2]
                named = dict(zip(_STATISTICS, (s.reshape(-1) for s in _described(w[1:], percentiles)), strict=True))
                place = np.tile(r["key"] * width + np.arange(voxels), k)
                yield pd.DataFrame({"feature": np.repeat(np.arange(k), voxels), "voxel_id": place, "weight": w[0].reshape(-1), **named})

    schema = ", ".join(["feature int, voxel_id long, weight double", *(f"{s} double" for s in _STATISTICS)])
    return sums.select("key", "flat").mapInPandas(fit, schema)


def ridge_prediction_bootstrap(
    frame: DataFrame, asked: DataFrame, features: str, k: int, replicates: int, alpha: float = 1.0, weigh: Signs | None = None,
    percentiles: tuple[float, float] = (2.5, 97.5), key: str = "image_id", values: str = "values", rows: int = 64,
) -> DataFrame:
    """key, voxel_id, predicted (by the data), mean, std, z, p, lo, hi of ridge predictions of asked(key, features).

    As ridge_weight_bootstrap; the rows asked for are dealt to shares of SHARE_ROWS at most (and of `rows` at least, where tasks would be
    idle), and a block of voxels, its replicates' weights still at hand, is sent once to each share and described there tile by tile. The
    result has a row for each row asked for and voxel.
    """
    if alpha <= 0:
        raise ValueError("alpha must be above 0, or a replicate may have no solution")
    sums, width = _weighted_products(frame, features, k, replicates, weigh or bootstrap_weights(), key, values)
    longest = frame.agg(F.max(F.size(values))).first()[0] or 0
    blocks, n = max(1, -(-longest // width)), asked.count()
    tasks = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, -(-n // SHARE_ROWS), min(-(-tasks // blocks), -(-n // rows)))
    solved = sums.select("key", "flat").mapInPandas(_weights(k, replicates, alpha), "key int, voxels int, w array<double>")
    sent = solved.select(F.col("key").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "voxels", "w")
    own = F.pmod(F.xxhash64(key), F.lit(shares)).cast("int").alias("share")
    wanted = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), own, F.col(key).alias("key_"), F.col(features).cast("array<double>").alias("x_"))
    met = wanted.unionByName(sent, allowMissingColumns=True).repartition(max(tasks, min(MOST_TASKS, blocks * shares)), "block", "share")
    names = [key, "voxel_id", "predicted", *_STATISTICS]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches)
        is_weights = held["voxels"].is_valid()
        weights, here = held.filter(is_weights), held.filter(pc.invert(is_weights))
        if not len(weights) or not len(here):
            return
        if here["x_"].null_count:
            raise ValueError("a row asked for has no features")
        voxels = weights["voxels"][0].as_py()
        w = pc.list_flatten(weights["w"]).to_numpy().reshape(replicates + 1, k, voxels)
        x = pc.list_flatten(here["x_"]).to_numpy().reshape(len(here), k)
        place = held["block"][0].as_py() * width + np.arange(voxels)
        step = max(1, TILE_VALUES // ((replicates + 1) * voxels))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            made = part @ w  # replicates x rows x voxels
            keys = here["key_"].take(pa.array(np.repeat(np.arange(at, at + len(part)), voxels))).combine_chunks()
            numbers = [made[0], *_described(made[1:], percentiles)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.tile(place, len(part))), *(pa.array(v.reshape(-1)) for v in numbers)], names=names)

    kind = dict(asked.dtypes)[key]
    schema = ", ".join([f"{key} {kind}, voxel_id long, predicted double", *(f"{s} double" for s in _STATISTICS)])
    return met.groupBy("block", "share").applyInArrow(predict, schema)


def _weights(k: int, replicates: int, alpha: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(r["key"], _solved(r, k, replicates, alpha)) for r in batch.to_dict("records")]
            yield pd.DataFrame({"key": [b for b, _ in made], "voxels": [w.shape[2] for _, w in made], "w": [w.reshape(-1) for _, w in made]})

    return run
