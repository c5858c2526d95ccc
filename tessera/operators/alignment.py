"""Functional alignment of subjects: Procrustes, hyperalignment and shared response models.

A subject is a row: subject, and a matrix of elements by samples as nested arrays. Every pass maps
subjects on their own and sums small matrices (samples by features, or samples by elements of a
template); a subject's data never meets another's in a task. Regional alignment does the same for each region,
where a region's data of all subjects is small enough for one group.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import array_center
from tessera.operators.inference import p_from_replicates, shuffled_places
from tessera.operators.sums import sum_arrays, sum_arrays_by
from tessera.operators.searchlight import coordinates, neighbour_lists
from tessera.sources.scratch import Scratch, keep

#: Times of a stretch at most, and numbers of the spheres that a task makes of one.
STRETCH, HELD = 1 << 10, 1 << 22


def procrustes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float]:
    """b rotated and scaled onto a: both standardised, the disparity, the rotation and the scale."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m - m.mean(axis=0), ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    if na == 0 or nb == 0:
        raise ValueError("a matrix without variance cannot be aligned")
    a, b = a / na, b / nb
    u, s, vt = np.linalg.svd(b.T @ a)
    rotation, scale = u @ vt, float(s.sum())
    turned = b @ rotation * scale
    return a, turned, float(((a - turned) ** 2).sum()), rotation, scale


def rotation_onto(x: np.ndarray, template: np.ndarray) -> np.ndarray:
    """The orthonormal map W that brings x (elements by samples) nearest to template (features by samples)."""
    u, _, vt = np.linalg.svd(x @ template.T, full_matrices=False)
    return u @ vt


def subject_matrices(long: DataFrame, subject: str = "subject", element: str = "voxel_id", sample: str = "t") -> DataFrame:
    """subject, matrix from the long form: elements and samples in order."""
    rows = long.groupBy(subject, element).agg(F.transform(F.array_sort(F.collect_list(F.struct(sample, "value"))), lambda x: x["value"]).alias("row"))
    return rows.groupBy(subject).agg(F.transform(F.array_sort(F.collect_list(F.struct(element, "row"))), lambda x: x["row"]).alias("matrix"))


def _matrix(cell) -> np.ndarray:
    return np.stack([np.asarray(r, float) for r in cell])


def _sum_over(frame: DataFrame, columns: list[str], function) -> np.ndarray:
    """The sum over subjects of a small matrix, function(row) -> array."""
    total = sum_arrays(frame.select(*columns), lambda batch: sum(function(row) for row in batch.itertuples(index=False)))
    if total is None:
        raise ValueError("there are no subjects")
    return total


def centred(subjects: DataFrame) -> DataFrame:
    """Each element of each subject less its mean over samples."""
    return subjects.withColumn("matrix", F.transform("matrix", array_center))


def det_srm(subjects: DataFrame, features: int, rounds: int = 10, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """The deterministic shared response model: maps (subject, w) and the response S (features by samples).

    Block coordinate descent: W_i is the orthonormal map nearest to X_i S', S the mean of W_i' X_i.
    All subjects need as many samples, at least `features` of them.
    """
    found = subjects.select(F.size(F.get("matrix", F.lit(0))).alias("n")).distinct().collect()
    if len(found) != 1 or found[0]["n"] < features:
        raise ValueError("subjects need equal numbers of samples, and no fewer than features")
    shared = np.linalg.qr(np.random.default_rng(seed).standard_normal((found[0]["n"], features)))[0].T

    with Scratch(subjects.sparkSession, "align") as scratch:
        data = scratch.save(subjects.select("matrix"))  # read again each round
        count = data.count()
        for _ in range(rounds):
            s = shared
            shared = _sum_over(data, ["matrix"], lambda r, s=s: rotation_onto(_matrix(r.matrix), s).T @ _matrix(r.matrix)) / count
    return _maps(subjects, shared), shared


def _maps(subjects: DataFrame, shared: np.ndarray) -> DataFrame:
    kind = dict(subjects.dtypes)["subject"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            maps = [rotation_onto(_matrix(m), shared) for m in b["matrix"]]
            yield pd.DataFrame({"subject": b["subject"], "w": [w.tolist() for w in maps]})

    return subjects.select("subject", "matrix").mapInPandas(run, f"subject {kind}, w array<array<double>>")


def srm(subjects: DataFrame, features: int, rounds: int = 10, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """The probabilistic shared response model by expectation-maximisation, on centred data.

    Per round one pass: each subject adds W_i' X_i / rho_i, from which S and its covariance follow;
    noise variances rho_i, a number a subject, are updated with the maps in the next pass.
    """
    with Scratch(subjects.sparkSession, "align") as scratch:
        data = scratch.save(centred(subjects))
        n = data.select(F.size(F.get("matrix", F.lit(0))).alias("n")).first()["n"]
        rho = {r["subject"]: 1.0 for r in data.select("subject").collect()}  # a number a subject
        rng = np.random.default_rng(seed)
        shared, sigma, trace = rng.standard_normal((features, n)), np.eye(features), 0.0

        for _ in range(rounds):
            s = shared
            total_inverse = sum(1 / v for v in rho.values())
            known = dict(rho)
            summed = _sum_over(data, ["subject", "matrix"], lambda r, s=s, k=known: rotation_onto(_matrix(r.matrix), s).T @ _matrix(r.matrix) / k[r.subject])
            posterior = np.linalg.inv(np.linalg.inv(sigma) + total_inverse * np.eye(features))
            shared = posterior @ summed
            sigma = posterior + shared @ shared.T / n
            trace = float(np.trace(sigma))

            def noise(batches: Iterator[pd.DataFrame], s=shared, t=trace) -> Iterator[pd.DataFrame]:
                for b in batches:
                    made = []
                    for m in b["matrix"]:
                        x = _matrix(m)
                        w = rotation_onto(x, s)
                        made.append(max((float((x * x).sum()) - 2 * float((w.T @ x * s).sum()) + n * t) / (n * len(x)), 1e-12))
                    yield pd.DataFrame({"subject": b["subject"], "rho": made})

            kind = dict(data.dtypes)["subject"]
            rho = {r["subject"]: r["rho"] for r in data.select("subject", "matrix").mapInPandas(noise, f"subject {kind}, rho double").collect()}
    return _maps(centred(subjects), shared), shared


def hyperalign(subjects: DataFrame, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """aligned (subject, w) and the template: subjects rotated to a template that is their mean, again and
    again, from the mean of the data; elements are padded to the largest subject by zeros."""
    width = subjects.agg(F.max(F.size("matrix")).alias("w")).first()["w"]

    def padded(m) -> np.ndarray:
        x = _matrix(m)
        x = x - x.mean(axis=1, keepdims=True)
        norm = np.linalg.norm(x)
        return np.pad(x / (norm if norm else 1.0), ((0, width - len(x)), (0, 0)))

    with Scratch(subjects.sparkSession, "align") as scratch:
        data = scratch.save(subjects.select("matrix"))
        count = data.count()
        template = _sum_over(data, ["matrix"], lambda r: padded(r.matrix)) / count
        for _ in range(rounds):
            t = template
            template = _sum_over(data, ["matrix"], lambda r, t=t: rotation_onto(padded(r.matrix), t).T @ padded(r.matrix)) / count
    kind = dict(subjects.dtypes)["subject"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"subject": b["subject"], "w": [rotation_onto(padded(m), template).tolist() for m in b["matrix"]]})

    return subjects.select("subject", "matrix").mapInPandas(run, f"subject {kind}, w array<array<double>>"), template


def transform(subjects: DataFrame, maps: DataFrame) -> DataFrame:
    """subject, shared: each subject's data in the shared space, W' X."""
    kind = dict(subjects.dtypes)["subject"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for m, w in zip(b["matrix"], b["w"], strict=True):
                x, w = _matrix(m), _matrix(w)
                made.append((w.T @ np.pad(x, ((0, len(w) - len(x)), (0, 0)))).tolist())
            yield pd.DataFrame({"subject": b["subject"], "shared": made})

    return subjects.join(maps, "subject").select("subject", "matrix", "w").mapInPandas(run, f"subject {kind}, shared array<array<double>>")


def align_regions(long: DataFrame, rounds: int = 2) -> DataFrame:
    """subject, roi, voxel_id, t, value: Procrustes alignment of each region's subjects to their mean.

    long(subject, roi, voxel_id, t, value). A region of one voxel keeps its values. Subjects need not have
    the same voxels or times: rotations come from the times that all subjects of the region have and turn
    all times of the subject; a voxel that a subject lacks, or lacks at some time, is at its mean. So each
    subject has all voxels of the region in the result. No shared time is an error.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if group["voxel_id"].nunique() < 2:
            return group[["subject", "roi", "voxel_id", "t", "value"]]
        voxels = np.sort(group["voxel_id"].unique())
        cubes = {s: g.pivot(index="t", columns="voxel_id", values="value").reindex(columns=voxels) for s, g in group.groupby("subject")}
        times = functools.reduce(lambda a, b: a.intersection(b), (c.index for c in cubes.values()))
        if not len(times):
            raise ValueError("subjects of a region need times that all of them have")
        whole = {s: (c - c.loc[times].mean()).fillna(0.0) for s, c in cubes.items()}
        whole = {s: c / (np.linalg.norm(c.loc[times]) or 1.0) for s, c in whole.items()}
        data = {s: c.loc[times].to_numpy() for s, c in whole.items()}
        template = np.mean(list(data.values()), axis=0)
        turns = {s: np.eye(len(voxels)) for s in data}
        for _ in range(rounds):
            turns = {s: rotation_onto(x.T, template.T) for s, x in data.items()}
            template = np.mean([x @ turns[s] for s, x in data.items()], axis=0)
        out = []
        for s, c in whole.items():
            frame = pd.DataFrame(c.to_numpy() @ turns[s], index=cubes[s].index, columns=cubes[s].columns).stack().rename("value").reset_index()
            out.append(frame.assign(subject=s, roi=group["roi"].iloc[0]))
        return pd.concat(out)[["subject", "roi", "voxel_id", "t", "value"]]

    kinds = dict(long.dtypes)
    return long.groupBy("roi").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in ("subject", "roi", "voxel_id", "t", "value")))


def assign(cost: np.ndarray) -> list[int]:
    """The assignment of rows to columns of least total cost (shortest augmenting paths)."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], j0
            j1 = free[np.argmin(least[free])]
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return [int(np.flatnonzero(match[1:] == i)[0]) for i in range(1, n + 1)]


def procrustes_distance(frame: DataFrame, a: str, b: str, key: str, replicates: int, order: Column | None = None, tail: str = "upper") -> DataFrame:
    """stat, p: the Procrustes similarity of two matrices, rows (key, a: array, b: array), by shuffled rows of a.

    The similarity is 1 less the disparity of both matrices, centred and of norm one: the squared sum of the singular
    values of A'B. A replicate needs its A'B alone: rows meet by their places in the shuffle, tasks add up outer products, and
    the small SVDs are spread over the replicates. Matrices of different widths are as if filled with zeros. `tail` as of the
    permutation tests. A side without variance is an error, as are null values.
    """

    def moments(batch: pd.DataFrame) -> np.ndarray:
        x, y = np.stack(batch[a].to_list()).astype(float), np.stack(batch[b].to_list()).astype(float)
        return np.concatenate([[len(x), (x * x).sum(), (y * y).sum()], x.sum(axis=0), y.sum(axis=0)])

    sums = sum_arrays(frame.select(a, b), moments)
    if sums is None:
        raise ValueError("there are no rows")
    wide = len(frame.select(a).first()[0])
    n, mean_a, mean_b = sums[0], sums[3 : 3 + wide] / sums[0], sums[3 + wide :] / sums[0]
    norm_a, norm_b = np.sqrt(max(sums[1] - n * mean_a @ mean_a, 0)), np.sqrt(max(sums[2] - n * mean_b @ mean_b, 0))
    if not (np.isfinite(norm_a) and np.isfinite(norm_b)) or norm_a <= 1e-12 * np.sqrt(sums[1]) or norm_b <= 1e-12 * np.sqrt(sums[2]):
        raise ValueError("a matrix without variance cannot be aligned")
    places = shuffled_places(frame, key, replicates, order)
    left = places.join(frame.select(key, a), key).select("replicate", "place", a)
    right = places.join(frame.select(key, b), key).select("replicate", F.col("old").alias("place"), b)
    met = left.join(right, ["replicate", "place"]).select("replicate", a, b)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, np.ndarray]]:
        held: dict = {}
        for batch in batches:
            for r, rows in batch.groupby("replicate"):
                made = (np.stack(rows[a].to_list()).astype(float) - mean_a).T @ (np.stack(rows[b].to_list()).astype(float) - mean_b)
                held[r] = held[r] + made if r in held else made
        yield from ((r, m.reshape(1, -1)) for r, m in held.items())

    cross = sum_arrays_by(met, "long", products, cells=wide * len(mean_b))

    def similarity(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                s = np.linalg.svd(np.stack(batch["flat"].to_list()).reshape(len(batch), wide, -1) / (norm_a * norm_b), compute_uv=False)
                yield pd.DataFrame({"replicate": batch["key"], "value": s.sum(axis=1) ** 2})

    stats = cross.select("key", "flat").mapInPandas(similarity, "replicate long, value double")
    return p_from_replicates(stats.withColumn("one", F.lit(1)), ["one"], tail).drop("one")


def align_states(states: DataFrame, reference: np.ndarray, metric: str = "correlation", group: str = "subject", state: str = "state", values: str = "values") -> DataFrame:
    """group, state, matched, cost: each group's states (rows with a vector) given to the rows of reference so that the
    group's total distance is least.

    metric "correlation" (1 - r; 1 where a side is constant) or "euclidean". A task makes the distances of its own
    vectors to the reference; a group's task gets those numbers alone, states by references. Of equally good assignments any
    is taken. States beyond the references' number are not matched (null); fewer leave references without a state. Null vectors are errors.
    """
    if metric not in ("correlation", "euclidean"):
        raise ValueError(f"metric is correlation or euclidean, not {metric!r}")
    reference = np.asarray(reference, float)
    kinds = dict(states.dtypes)

    def costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch[values].to_list()).astype(float)
            if metric == "euclidean":
                made = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ reference.T + (reference * reference).sum(axis=1), 0))
            else:
                u, v = x - x.mean(axis=1, keepdims=True), reference - reference.mean(axis=1, keepdims=True)
                size = np.linalg.norm(u, axis=1)[:, None] * np.linalg.norm(v, axis=1)
                made = 1 - np.divide(u @ v.T, size, out=np.zeros((len(x), len(reference))), where=size > 1e-12)
            yield batch[[group, state]].assign(costs=list(made))

    def matched(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(state).reset_index(drop=True)
        cost = np.stack(table["costs"].to_list())
        if len(cost) <= cost.shape[1]:
            to = [(k, c) for k, c in enumerate(assign(cost))]
        else:
            to = [(k, c) for c, k in enumerate(assign(cost.T))]
        out = table[[group, state]].assign(matched=pd.array([None] * len(table), dtype="Int32"), cost=np.nan)
        for k, c in to:
            out.loc[k, "matched"], out.loc[k, "cost"] = c, cost[k, c]
        return out

    schema = f"{group} {kinds[group]}, {state} {kinds[state]}"
    made = states.select(group, state, values).mapInPandas(costs, f"{schema}, costs array<double>")
    return made.groupBy(group).applyInPandas(matched, f"{schema}, matched int, cost double")


def _stretch(voxels: int, radius: float, piece: int) -> int:
    """Times of a row: as many as a task can hold of the spheres of one piece."""
    sphere = min(voxels, (2 * int(radius) + 1) ** 3)
    return max(16, min(STRETCH, HELD // (sphere * min(piece, voxels))))


def local_rows(images: DataFrame, points: np.ndarray, radius: float, piece: int = 256) -> DataFrame:
    """center, subject, stretch, matrix (sphere by times, row by row), times: each subject's series in each sphere, cut into stretches of times.

    images(subject, t: places from 0, values). Images are cut by pieces of centres, each with the voxels of its spheres; a task
    makes the spheres of one piece, subject and stretch, whatever the number of times.
    """
    pieces = [np.arange(lo, min(lo + piece, len(points))) for lo in range(0, len(points), piece)]
    long = _stretch(len(points), radius, piece)
    kind = dict(images.dtypes)["subject"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach = [np.unique(neighbour_lists(points, c, radius)[0]) for c in pieces]
        for batch in batches:
            for n, own in enumerate(reach):
                if len(batch):
                    yield pd.DataFrame({"subject": batch["subject"], "t": batch["t"], "stretch": batch["t"] // long, "piece": n, "x": [np.asarray(v, float)[own] for v in batch["values"]]})

    def spheres(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        centers = pieces[group["piece"].iloc[0]]
        listed, begin = neighbour_lists(points, centers, radius)
        x = np.stack(group["x"].to_list()).T  # voxels by times
        at = np.searchsorted(np.unique(listed), listed)
        made = [x[at[a:b]].reshape(-1) for a, b in zip(begin[:-1], begin[1:], strict=True)]
        same = {c: [group[c].iloc[0]] * len(made) for c in ("subject", "stretch")}
        return pd.DataFrame({"center": centers, **same, "matrix": made, "times": [x.shape[1]] * len(made)})

    rows = images.select("subject", "t", "values").mapInPandas(cut, f"subject {kind}, t long, stretch long, piece int, x array<double>")
    return rows.groupBy("piece", "subject", "stretch").applyInPandas(spheres, f"center int, subject {kind}, stretch long, matrix array<double>, times int")


def align_local(
    images: DataFrame, voxels: DataFrame, radius: float, method: str = "hyperalignment", features: int | None = None, rounds: int = 2, subject: str = "subject", t: str = "t", values: str = "values", seed: int = 0
) -> DataFrame:
    """subject, voxel_id, t (its place from 0), value: each voxel by the alignment of the sphere around it.

    images(subject, t, values): all subjects at the same number of times. In each sphere subjects' data, centred over time and of norm one, are
    mapped to a template by rotations: "hyperalignment" starts from their mean, "srm" from `features` random responses (deterministic
    shared response); the template is the mean of what is mapped, `rounds` times. A voxel's value is its row of the
    template's image in the subject's space: hyperalignment turns the subject's data into the template's axes and keeps the
    axis of the centre; srm gives the response as the centre voxel of that subject sees it.

    A row is a stretch of one subject's sphere, saved once; a task maps its rows. Rotations come from products of a sphere and its template, which are
    summed over stretches, and templates' sums meet by sphere and stretch on the executors, so what a task holds depends neither on the
    subjects nor on the times. (srm's random responses of one sphere are made in one task.) Overlapping spheres are each for themselves.
    """
    if method not in ("hyperalignment", "srm"):
        raise ValueError(f"method is hyperalignment or srm, not {method!r}")
    points = coordinates(voxels)
    kind = dict(images.dtypes)[subject]
    held = images.select(F.col(subject).alias("subject"), F.col(t).alias("at"), F.col(values).cast("array<double>").alias("values"))
    counts = [r["count"] for r in held.groupBy("subject").count().select("count").distinct().limit(2).collect()]
    if len(counts) > 1:
        raise ValueError("subjects need equal numbers of times")
    n_times, long = counts[0] if counts else 0, _stretch(len(points), radius, 256)
    parts = max(1, -(-n_times // long))
    scratch = Scratch(images.sparkSession, "local")

    def rotations(rows: DataFrame, templated: bool) -> DataFrame:
        """of_center, of_subject, w (sphere by axes), norm: each sphere's map to the template that its rows carry, or to itself."""

        def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made = []
                for r in batch.to_dict("records"):
                    x = np.asarray(r["matrix"], float).reshape(-1, r["times"])
                    cross = x @ np.asarray(r["template"], float).reshape(-1, r["times"]).T if templated else np.zeros((len(x), 0))
                    made.append(np.append(cross.reshape(-1), [(x * x).sum(), len(x)]))
                yield pd.DataFrame({"center": batch["center"], "subject": batch["subject"], "flat": made})

        def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict = {}
            for batch in batches:
                for c, s, flat in batch[["center", "subject", "flat"]].itertuples(index=False):
                    total[c, s] = total[c, s] + flat if (c, s) in total else np.array(flat, float)
            for (c, s), flat in total.items():
                high, norm = int(round(flat[-1] / parts)), float(np.sqrt(flat[-2])) or 1.0
                if templated:
                    u, _, vt = np.linalg.svd(flat[:-2].reshape(high, -1) / norm, full_matrices=False)
                yield pd.DataFrame({"of_center": [c], "of_subject": [s], "w": [(u @ vt if templated else np.eye(high)).reshape(-1)], "norm": [norm]})

        made = rows.mapInPandas(products, f"center int, subject {kind}, flat array<double>").repartition("center", "subject")
        return made.mapInPandas(solved, f"of_center int, of_subject {kind}, w array<double>, norm double")

    def mapped(data: DataFrame, maps: DataFrame) -> DataFrame:
        return data.join(maps, (F.col("center") == F.col("of_center")) & F.col("subject").eqNullSafe(F.col("of_subject")))

    def means(rows: DataFrame) -> DataFrame:
        """of_center, of_stretch, template (axes by times): the mean of what rows' maps make of them."""

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, np.ndarray]]:
            for batch in batches:
                for r in batch.to_dict("records"):
                    x = np.asarray(r["matrix"], float).reshape(-1, r["times"]) / r["norm"]
                    made = np.asarray(r["w"], float).reshape(len(x), -1).T @ x
                    yield r["center"] * parts + r["stretch"], np.append(made.reshape(-1), 1.0)[None, :]

        sums = sum_arrays_by(rows, "long", add, cells=1 << 24)
        n = F.element_at("flat", -1)
        mean = F.transform(F.slice("flat", 1, F.size("flat") - 1), lambda v: v / n)
        return sums.select(F.expr(f"CAST(key DIV {parts} AS INT)").alias("of_center"), (F.col("key") % parts).alias("of_stretch"), mean.alias("template"))

    def against(data: DataFrame, template: DataFrame) -> DataFrame:
        return data.join(template, (F.col("center") == F.col("of_center")) & (F.col("stretch") == F.col("of_stretch"))).drop("of_center", "of_stretch")

    def random_responses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for center in batch["center"]:
                high = len(neighbour_lists(points, np.array([center]), radius)[0])
                k = min(features or high, high, n_times)
                made = np.linalg.qr(np.random.default_rng([seed, center]).standard_normal((n_times, k)))[0].T
                for n in range(parts):
                    yield pd.DataFrame({"of_center": [center], "of_stretch": [n], "template": [made[:, n * long : (n + 1) * long].reshape(-1)]})

    with scratch:
        # each voxel less its mean over times; times by their places
        flat = held.select("subject", F.posexplode("values").alias("v", "x")).groupBy("subject", "v").agg(F.avg("x").alias("x"))
        mean = flat.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("v", "x"))), lambda p: p["x"]).alias("mean"))
        placed = held.withColumn("t", (F.row_number().over(Window.partitionBy("subject").orderBy("at")) - 1).cast("long"))
        centred_images = placed.join(mean.withColumnRenamed("subject", "of_subject"), F.col("subject").eqNullSafe(F.col("of_subject")))
        centred_images = centred_images.select("subject", "t", F.zip_with("values", "mean", lambda x, m: x - m).alias("values"))
        data = scratch.save(local_rows(centred_images, points, radius))
        if method == "srm":
            centers = images.sparkSession.range(len(points)).select(F.col("id").cast("int").alias("center"))
            template = scratch.save(centers.mapInPandas(random_responses, "of_center int, of_stretch long, template array<double>"))
            maps = scratch.save(rotations(against(data, template), True))
        else:
            maps = scratch.save(rotations(data, False))
        template = scratch.save(means(mapped(data, maps)))
        for _ in range(rounds - 1):
            maps = scratch.save(rotations(against(data, template), True))
            template = scratch.save(means(mapped(data, maps)))
        maps = scratch.save(rotations(against(data, template), True))

        def centre_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.to_dict("records"):
                    x = np.asarray(r["matrix"], float).reshape(-1, r["times"]) / r["norm"]
                    w = np.asarray(r["w"], float).reshape(len(x), -1)
                    listed, _ = neighbour_lists(points, np.array([r["center"]]), radius)
                    own = int(np.flatnonzero(listed == r["center"])[0])
                    made = w[:, own] @ x if method == "hyperalignment" else w[own] @ np.asarray(r["template"], float).reshape(-1, r["times"])
                    yield pd.DataFrame({"subject": r["subject"], "voxel_id": r["center"], "t": r["stretch"] * long + np.arange(r["times"]), "value": made})

        met = mapped(data if method == "hyperalignment" else against(data, template), maps)
        return keep(met.mapInPandas(centre_rows, f"subject {kind}, voxel_id int, t long, value double"), "local")
