"""Permutation tests, bootstraps and inter-subject correlation.

A replicate is named by its number; what it does to a sample (a sign, a weight, a new place) is a
hash of seed, replicate and sample id, so any task can make it alone and reruns agree. Sums over
samples are made for all replicates at once in each task, as one matrix product, and only those sums
are shuffled: replicates times elements, whatever the number of samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import corr_of_moments, moments, safe_div
from tessera.operators.ranks import ordered_places
from tessera.operators.sizes import sent

Signs = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _hash(ids: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """64 random bits for each replicate (rows) and id (columns)."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.int64).view(np.uint64)[None, :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ ((replicates.astype(np.uint64)[:, None] + np.uint64(seed + 1)) * np.uint64(0xC2B2AE3D27D4EB4F))
        for k, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(k))) * np.uint64(m)
        return x ^ (x >> np.uint64(31))


def random_signs(seed: int = 0) -> Signs:
    """+1 or -1 for each replicate and id; replicate 0 changes nothing."""

    def signs(ids: np.ndarray, replicates: np.ndarray) -> np.ndarray:
        s = 1.0 - 2.0 * (_hash(ids, replicates, seed) & np.uint64(1)).astype(float)
        s[replicates == 0] = 1.0
        return s

    return signs


def bootstrap_weights(seed: int = 0) -> Signs:
    """Poisson(1) counts, the bootstrap whose samples need not know each other; replicate 0 is the data."""
    cuts = np.cumsum([np.exp(-1) / np.prod(range(1, k + 1)) for k in range(12)])

    def weights(ids: np.ndarray, replicates: np.ndarray) -> np.ndarray:
        u = (_hash(ids, replicates, seed) >> np.uint64(11)).astype(float) / (1 << 53)
        w = np.searchsorted(cuts, u).astype(float)
        w[replicates == 0] = 1.0
        return w

    return weights


#: Bytes of the sums that a task holds at a time; where those of all replicates are more, each batch's leave the task.
HELD_BYTES = 256 << 20


def _products(frame: DataFrame, columns: Sequence[str], numbers: np.ndarray, weigh: Callable[[pd.DataFrame, np.ndarray], np.ndarray]) -> DataFrame:
    """replicate, voxel_id, total, weight: sums over rows of weight times value, weigh(rows, numbers) being the
    weights, a row a replicate. Replicates go in blocks, so a task holds HELD_BYTES of sums and one block more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                x = np.stack(part["values"].to_list())
                step = max(1, HELD_BYTES // (8 * max(1, x.shape[1])))
                for lo in range(0, len(numbers), step):
                    w = weigh(part, numbers[lo : lo + step])
                    sums, weight = w @ x, w.sum(axis=1)
                    if lo in held:
                        held[lo] = held[lo][0] + sums, held[lo][1] + weight
                    else:
                        held[lo] = sums, weight
                    if step < len(numbers):
                        yield made(lo, *held.pop(lo))
        for lo, (sums, weight) in held.items():
            yield made(lo, sums, weight)

    def made(lo: int, sums: np.ndarray, weight: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"replicate": numbers[lo : lo + len(sums)], "totals": list(sums), "weight": weight})

    sums = frame.select(*columns, "values").mapInPandas(run, "replicate long, totals array<double>, weight double")
    return (
        sums.select("replicate", "weight", F.posexplode("totals").alias("voxel_id", "total"))
        .groupBy("replicate", "voxel_id")
        .agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    )


def weighted_sums(frame: DataFrame, replicates: int, weigh: Signs, key: str = "image_id") -> DataFrame:
    """replicate, voxel_id, total, weight: sums over samples of weight times value, replicate 0 being the
    data itself. One row of sums a task and replicate is shuffled."""
    return _products(frame, [key], np.arange(replicates + 1), lambda rows, numbers: weigh(rows[key].to_numpy(), numbers))


def _beyond(null: Column, observed: Column, tail: str) -> Column:
    """Whether a replicate is at least as extreme; equal up to rounding counts."""
    slack = 1e-12
    return {
        "two": F.abs(null) >= F.abs(observed) - slack,
        "upper": null >= observed - slack,
        "lower": null <= observed + slack,
    }[tail]


def p_from_replicates(stats: DataFrame, by: Sequence[str], tail: str = "two") -> DataFrame:
    """by..., stat, p = (beyond + 1) / (n + 1) of stats(replicate, by..., value), read once: the replicates of one
    `by` are one row. p is null where stat or all replicates are."""
    other = F.col("replicate") > 0
    own = F.col("replicate") == 0
    held = stats.groupBy(*by).agg(
        F.count(F.when(own, 1)).alias("own_"), F.max(F.when(own, F.col("value"))).alias("stat"), F.count(F.when(other, 1)).alias("n_"), F.collect_list(F.when(other, F.col("value"))).alias("null_")
    )
    beyond = F.size(F.filter("null_", lambda v: _beyond(v, F.col("stat"), tail)))
    p = F.when(F.col("stat").isNotNull() & (F.size("null_") > 0), (beyond + 1) / (F.col("n_") + 1))
    return held.filter("own_ > 0 AND n_ > 0").select(*by, "stat", p.alias("p"))


def one_sample_permutation(frame: DataFrame, replicates: int, signs: Signs | None = None, tail: str = "two") -> DataFrame:
    """voxel_id, stat (the mean), p by sign flips of images."""
    sums = weighted_sums(frame, replicates, signs or random_signs())
    n = F.broadcast(frame.agg(F.count(F.lit(1)).alias("n")))
    return p_from_replicates(sums.join(n).withColumn("value", F.col("total") / F.col("n")), ["voxel_id"], tail)


def shuffled_places(ids: DataFrame, key: str, replicates: int, order: Column | None = None) -> DataFrame:
    """replicate, key, place, old: a random order of the samples for each replicate, replicate 0 their own.

    Places are counted over range partitions, so neither a replicate nor the samples are one task; the own order is made once
    for all replicates. The table has replicates times samples rows.
    """
    own = ordered_places(ids.select(key), [], [key], "old")
    grid = own.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates)).cast("array<bigint>")))
    mixed = order if order is not None else F.xxhash64("replicate", key)
    placed = ordered_places(grid.withColumn("mixed_", F.when(F.col("replicate") == 0, F.col(key)).otherwise(mixed)), ["replicate"], ["mixed_", key])
    return placed.select("replicate", key, "place", "old")


def two_sample_permutation(frame: DataFrame, first: Column, replicates: int, order: Column | None = None, tail: str = "two") -> DataFrame:
    """voxel_id, stat (the difference of means), p by shuffled labels. frame: image_id (once each), values, ...
    Null values are left out of the means."""
    named = frame.withColumn("first", first)
    n1 = F.broadcast(named.agg(F.sum(F.col("first").cast("long")).alias("n1")))
    # those of the first group come first in order, so a shuffle's first n1 places are its first group
    ids = named.select(F.struct((~F.col("first")).alias("late"), F.col("image_id").cast("long").alias("image_id")).alias("id"))
    if order is None:  # a struct, as the samples' own order is
        order = F.struct(F.lit(False).alias("late"), F.xxhash64("replicate", F.col("id.image_id")).alias("image_id"))
    places = shuffled_places(ids, "id", replicates, order).join(n1)
    ones = places.groupBy(F.col("id.image_id").alias("image_id")).agg(F.collect_list(F.when(F.col("place") <= F.col("n1"), F.col("replicate"))).alias("ones"))
    # each value and whether it is there, in turn; all replicates of an image are one row, and meet its values once
    pairs = F.flatten(F.transform("values", lambda x: F.array(F.coalesce(x, F.lit(0.0)).cast("double"), x.isNotNull().cast("double"))))
    vectors = named.select("image_id", pairs.alias("values")).join(ones, "image_id")
    whole = replicates + 1  # the number of the sums over all samples

    def weigh(rows: pd.DataFrame, numbers: np.ndarray) -> np.ndarray:
        w = np.zeros((len(numbers), len(rows)))
        for k, listed in enumerate(rows["ones"]):
            at = np.asarray(listed, np.int64) - numbers[0]
            w[at[(at >= 0) & (at < len(numbers))], k] = 1.0
        w[numbers == whole] = 1.0
        return w

    sums = _products(vectors, ["ones"], np.arange(whole + 1), weigh)
    at = F.floor(F.col("voxel_id") / 2).cast("int")
    total = lambda rest: F.sum(F.when(F.col("voxel_id") % 2 == rest, F.col("total")))
    cells = sums.groupBy("replicate", at.alias("voxel_id")).agg(total(0).alias("s"), total(1).alias("n"))
    of_all = lambda c: F.max(F.when(F.col("replicate") == whole, F.col(c))).alias(f"{c}_all")
    listed = F.collect_list(F.when(F.col("replicate") < whole, F.struct("replicate", "s", "n"))).alias("cells")
    cells = cells.groupBy("voxel_id").agg(of_all("s"), of_all("n"), listed).select("voxel_id", "s_all", "n_all", F.inline("cells"))
    mean = lambda s, n: F.when(n > 0, s / F.when(n > 0, n))  # noqa: E731  null of no values
    difference = mean(F.col("s"), F.col("n")) - mean(F.col("s_all") - F.col("s"), F.col("n_all") - F.col("n"))
    return p_from_replicates(cells.withColumn("value", difference), ["voxel_id"], tail)


def correlation_permutation(frame: DataFrame, x: str, y: str, key: str, replicates: int, order: Column | None = None, tail: str = "two") -> DataFrame:
    """stat (Pearson's r), p by shuffled rows of x against y."""
    places = shuffled_places(frame, key, replicates, order)
    xs = places.join(frame.select(key, x), key).select("replicate", "place", x)
    ys = places.join(frame.select(key, y), key).select("replicate", F.col("old").alias("place"), y)
    r = xs.join(ys, ["replicate", "place"]).groupBy("replicate").agg(*moments(x, y)).select("replicate", corr_of_moments().alias("value"))
    return p_from_replicates(r.withColumn("one", F.lit(1)), ["one"], tail).drop("one")


def circle_shift_permutation(frame: DataFrame, x: str, y: str, row: str, shifts: Sequence[int], by: Sequence[str], tail: str = "two") -> DataFrame:
    """by..., stat, p of the correlation of two series under rotations of x."""
    n = frame.groupBy(*by).agg(F.count(F.lit(1)).alias("n_"))
    moved = frame.join(n, list(by)).select(*by, row, x, "n_", F.posexplode(F.array(*[F.lit(int(s)) for s in [0, *shifts]])).alias("replicate", "s_"))
    moved = moved.select(*by, "replicate", F.pmod(F.col(row) + F.col("s_"), F.col("n_")).alias(row), x)
    r = moved.join(frame.select(*by, row, y), [*by, row]).groupBy(*by, "replicate").agg(*moments(x, y)).select(*by, "replicate", corr_of_moments().alias("value"))
    return p_from_replicates(r, by, tail)


def matrix_permutation(a: DataFrame, b: DataFrame, moves: DataFrame, tail: str = "two") -> DataFrame:
    """stat, p of Mantel's test: square(i, j, value) of a with rows and columns moved together by
    moves(replicate, i, to), against the upper triangle of b. Replicate 0 moves nothing."""
    left, right = moves.select("replicate", "i", F.col("to").alias("ti")), moves.select("replicate", F.col("i").alias("j"), F.col("to").alias("tj"))
    moved = a.join(sent(left), "i").join(sent(right), ["replicate", "j"]).select("replicate", F.col("ti").alias("i"), F.col("tj").alias("j"), "value")
    other = b.select("i", "j", F.col("value").alias("other"))
    r = moved.filter("i < j").join(other, ["i", "j"]).groupBy("replicate").agg(*moments("value", "other")).select("replicate", corr_of_moments().alias("value"))
    return p_from_replicates(r.withColumn("one", F.lit(1)), ["one"], tail).drop("one")


def bootstrap(frame: DataFrame, replicates: int, z: float = 1.959963984540054) -> DataFrame:
    """voxel_id, mean, std (ddof 1), z, lo, hi of the mean under the Poisson bootstrap."""
    sums = weighted_sums(frame, replicates, bootstrap_weights()).filter("replicate > 0 AND weight > 0")
    s = sums.groupBy("voxel_id").agg(F.avg(F.col("total") / F.col("weight")).alias("mean"), F.stddev_samp(F.col("total") / F.col("weight")).alias("std"))
    return s.select(
        "voxel_id", "mean", "std", safe_div(F.col("mean"), F.col("std")).alias("z"), (F.col("mean") - z * F.col("std")).alias("lo"), (F.col("mean") + z * F.col("std")).alias("hi")
    )


# inter-subject correlation: frame(subject, t, voxel_id, value)


def isc_leave_one_out(frame: DataFrame) -> DataFrame:
    """subject, voxel_id, r of each subject with the mean of the others: totals first, then the total
    less the subject's own."""
    total = frame.groupBy("t", "voxel_id").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("k"))
    others = frame.join(total, ["t", "voxel_id"]).filter("k > 1").withColumn("others", (F.col("total") - F.col("value")) / (F.col("k") - 1))
    return others.groupBy("subject", "voxel_id").agg(*moments("value", "others")).select("subject", "voxel_id", corr_of_moments().alias("r"))


#: Voxels of a piece of isc_pairwise, and the values of subjects, times and voxels that it holds, about.
VOXELS, PIECE = 32, 1 << 20


def isc_pairwise(frame: DataFrame) -> DataFrame:
    """a, b, voxel_id, r of each pair of subjects, a < b, over the times both have.

    A piece is some voxels at some times of all subjects; its sums of products for all pairs are matrix products, and
    the pieces of a voxel add up, so no row is made for a pair and time. Null and NaN values count as absent, pairs without a
    common time do not appear, r is 0 of a constant side; repeated (subject, t, voxel) are averaged. Subjects are listed on the driver.
    """
    subjects = sorted(r[0] for r in frame.select("subject").distinct().collect() if r[0] is not None)
    place = {s: k for k, s in enumerate(subjects)}
    n = len(subjects)
    times = max(1, PIECE // (VOXELS * max(1, n)))
    kinds = dict(frame.dtypes)

    def products(group: pd.DataFrame) -> pd.DataFrame:
        group = group.dropna(subset=["subject", "value"])
        voxels, v = np.unique(group["voxel_id"].to_numpy(), return_inverse=True)
        t = pd.factorize(group["t"])[0]
        cube, seen = np.zeros((len(voxels), n, t.max(initial=-1) + 1)), np.zeros((len(voxels), n, t.max(initial=-1) + 1))
        at = (v, group["subject"].map(place).to_numpy(np.int64), t)
        np.add.at(cube, at, group["value"].to_numpy(float))
        np.add.at(seen, at, 1.0)
        cube, seen = cube / np.maximum(seen, 1), np.minimum(seen, 1)
        turned, mask = cube.transpose(0, 2, 1), seen.transpose(0, 2, 1)
        # n, sum of a, sum of its squares (of pairs a, b at the times both have), sum of products
        sums = np.stack([seen @ mask, cube @ mask, (cube * cube) @ mask, cube @ turned], axis=1)
        return pd.DataFrame({"voxel_id": voxels, "sums": list(sums.reshape(len(voxels), 4 * n * n))})

    def correlations(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        count, s, q, xy = np.sum(np.stack(group["sums"].to_list()), axis=0).reshape(4, n, n)
        var = count * q - s * s
        varied = (var > 1e-12) & (var.T > 1e-12)
        r = np.where(varied, (count * xy - s * s.T) / np.sqrt(np.where(varied, var * var.T, 1.0)), 0.0)
        a, b = np.nonzero(np.triu(count, 1))
        names = np.array(subjects, object)
        return pd.DataFrame({"a": names[a], "b": names[b], "voxel_id": [key[0]] * len(a), "r": r[a, b]})

    pieces = frame.select("subject", "t", "voxel_id", "value", F.floor(F.col("voxel_id") / VOXELS).alias("some"), F.pmod(F.hash("t"), F.lit(_time_pieces(frame, times))).alias("when"))
    sums = pieces.groupBy("some", "when").applyInPandas(products, f"voxel_id {kinds['voxel_id']}, sums array<double>")
    return sums.groupBy("voxel_id").applyInPandas(correlations, f"a {kinds['subject']}, b {kinds['subject']}, voxel_id {kinds['voxel_id']}, r double")


def _time_pieces(frame: DataFrame, times: int) -> int:
    """Into how many pieces the times go, by hash, so that one holds about `times` of them."""
    return max(1, -(-(frame.agg(F.approx_count_distinct("t")).first()[0] or 0) // times))


def summarize_isc(rs: DataFrame, how: str = "median", clip: float = 0.999) -> DataFrame:
    """voxel_id, isc: the median, or the mean through Fisher's z of clipped correlations."""
    held = F.greatest(F.least(F.col("r"), F.lit(clip)), F.lit(-clip))
    return rs.groupBy("voxel_id").agg((F.percentile("r", 0.5) if how == "median" else F.tanh(F.avg(F.atanh(held)))).alias("isc"))


def isc_bootstrap(rs: DataFrame, replicates: int) -> DataFrame:
    """voxel_id, isc, p, lo, hi of leave-one-out correlations under resampled subjects; the null is
    centred on what was observed. rs(subject, voxel_id, r) has a row a subject."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("subject")
        r = group["r"].to_numpy()
        picks = (_hash(np.arange(len(r)), np.arange(1, replicates + 1), 7) % np.uint64(len(r))).astype(int)
        observed, null = np.median(r), np.median(r[picks], axis=1)
        p = ((np.abs(null - observed) >= abs(observed)).sum() + 1) / (replicates + 1)
        lo, hi = np.percentile(null, [2.5, 97.5])
        return pd.DataFrame({"voxel_id": [group["voxel_id"].iloc[0]], "isc": [observed], "p": [p], "lo": [lo], "hi": [hi]})

    return rs.groupBy("voxel_id").applyInPandas(run, f"voxel_id {dict(rs.dtypes)['voxel_id']}, isc double, p double, lo double, hi double")


def isc_group_difference(rs: DataFrame, first: Column, replicates: int) -> DataFrame:
    """voxel_id, difference of the groups' median correlations, p by shuffled subject labels."""
    named = rs.withColumn("first", first)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("subject")
        r, f = group["r"].to_numpy(), group["first"].to_numpy(bool)
        order = np.argsort(_hash(np.arange(len(r)), np.arange(1, replicates + 1), 9), axis=1)
        observed = np.median(r[f]) - np.median(r[~f])
        shuffled = f[order]
        null = np.array([np.median(r[s]) - np.median(r[~s]) for s in shuffled])
        p = ((np.abs(null) >= abs(observed) - 1e-12).sum() + 1) / (replicates + 1)
        return pd.DataFrame({"voxel_id": [group["voxel_id"].iloc[0]], "difference": [observed], "p": [p]})

    return named.groupBy("voxel_id").applyInPandas(run, f"voxel_id {dict(rs.dtypes)['voxel_id']}, difference double, p double")


#: Elements in a block of a table of all pairs of elements, about.
BLOCK = 256


def block_correlations(x: DataFrame, y: DataFrame, by: str, row: str, blocks: int) -> DataFrame:
    """by, i, j, r: Pearson's r over `row` of each series x(by, row, i, x) with each y(by, row, j, y) of one `by`.

    Elements are hashed into blocks; a group is a pair of blocks of one `by`, and its correlations are a few
    matrix products. Each side is sent as often as the other has blocks, and no row is made for a pair and
    row. Null and NaN count as absent; pairs without a common row do not appear; r is 0 of a constant side;
    repeated (row, element) are averaged. A group holds 2 * BLOCK series of one `by`, so its rows must be bounded.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = x.select(by, row, "i", "x", F.pmod(F.hash("i"), F.lit(blocks)).alias("block_i"), every.alias("block_j"))
    # named anew, so that both sides may come from one table
    right = y.select(F.col(by).alias("by_y"), F.col(row).alias("row_y"), "j", "y", every.alias("block_i"), F.pmod(F.hash("j"), F.lit(blocks)).alias("block_j"))
    kinds = dict(x.dtypes) | dict(y.dtypes)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        p, q = (f.groupby([row_, e])[v].mean().unstack(e) for f, row_, e, v in ((a, row, "i", "x"), (b, "row_y", "j", "y")))
        shared = p.index.intersection(q.index)
        if not len(shared):
            return pd.DataFrame({by: [], "i": [], "j": [], "r": []})
        u, v = p.loc[shared].to_numpy(float), q.loc[shared].to_numpy(float)
        m, k = (~np.isnan(u)).astype(float), (~np.isnan(v)).astype(float)
        u, v = np.nan_to_num(u), np.nan_to_num(v)
        n, sx, sy = m.T @ k, u.T @ k, m.T @ v
        vx, vy = n * ((u * u).T @ k) - sx * sx, n * (m.T @ (v * v)) - sy * sy
        varied = (vx > 1e-12) & (vy > 1e-12)
        r = np.where(varied, (n * (u.T @ v) - sx * sy) / np.sqrt(np.where(varied, vx * vy, 1.0)), 0.0)
        i, j = np.nonzero(n)
        return pd.DataFrame({by: [a[by].iloc[0]] * len(i), "i": p.columns.to_numpy()[i], "j": q.columns.to_numpy()[j], "r": r[i, j]})

    keys = ("block_i", "block_j")
    return left.groupBy(by, *keys).cogroup(right.groupBy("by_y", *keys)).applyInPandas(run, f"{by} {kinds[by]}, i {kinds['i']}, j {kinds['j']}, r double")


def isfc(frame: DataFrame) -> DataFrame:
    """subject, i, j, r: each region of a subject with each region of the others' mean, by blocks of regions."""
    total = frame.groupBy("t", "voxel_id").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("k"))
    others = frame.join(total, ["t", "voxel_id"]).filter("k > 1")
    mean = others.select("subject", "t", F.col("voxel_id").alias("j"), ((F.col("total") - F.col("value")) / (F.col("k") - 1)).alias("y"))
    own = frame.select("subject", "t", F.col("voxel_id").alias("i"), F.col("value").alias("x"))
    blocks = max(1, -(-frame.select("voxel_id").distinct().count() // BLOCK))
    return block_correlations(own, mean, "subject", "t", blocks)


def bootstrap_splits(ids: DataFrame, key: str, replicates: int, seed: int = 0) -> DataFrame:
    """replicate, key, weight, held_out: Poisson counts of each sample; those of weight 0 are out of bag."""
    weigh = bootstrap_weights(seed)
    numbers = np.arange(1, replicates + 1)
    kind = dict(ids.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            w = weigh(batch[key].to_numpy(), numbers)
            yield pd.DataFrame({"replicate": np.repeat(numbers, len(batch)), key: np.tile(batch[key].to_numpy(), len(numbers)), "weight": w.reshape(-1)})

    drawn = ids.select(key).mapInPandas(run, f"replicate long, {key} {kind}, weight double")
    return drawn.withColumn("held_out", F.col("weight") == 0)
