"""Work on neighbourhoods of dense images as sparse matrices: means and distances in spheres, smoothing, resampling between grids.

A task holds the voxels' coordinates (12 bytes each, whatever the number of images) and makes the neighbour lists of the
centres that it works on; no row is made for a sphere and one of its voxels.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import pairs

#: Images of a side of a tile of pairs that a task has at a time, of the other side where pairs are tables, and centres that one piece of work has.
IMAGES, ACROSS, CENTRES = 128, 512, 256
#: Bytes of coordinates, or of resampling weights, that are sent to all tasks at most.
SENT_BYTES = 512 << 20


def coordinates(voxels: DataFrame) -> np.ndarray:
    """i, j, k of voxels 0, 1, ... of a grid's dimension table, whose size is checked."""
    rows = voxels.orderBy("voxel_id").select("voxel_id", "i", "j", "k").toPandas()
    if rows["voxel_id"].tolist() != list(range(len(rows))):
        raise ValueError("voxels are numbered from 0 without gaps")
    if 12 * len(rows) > SENT_BYTES:
        raise ValueError("more voxels than tasks can hold the coordinates of")
    return rows[["i", "j", "k"]].to_numpy(np.int32)


class Grid:
    """Voxels found by their place."""

    def __init__(self, points: np.ndarray) -> None:
        self.low, self.size = points.min(axis=0), np.ptp(points, axis=0).astype(np.int64) + 1
        keys = self._keys(points.astype(np.int64))
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def _keys(self, points: np.ndarray) -> np.ndarray:
        a, b, c = (points - self.low).T
        return (a * self.size[1] + b) * self.size[2] + c

    def find(self, points: np.ndarray) -> np.ndarray:
        """The voxel at each place, -1 where there is none."""
        inside = ((points >= self.low) & (points < self.low + self.size)).all(axis=1)
        keys = np.where(inside, self._keys(points), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


def neighbour_lists(points: np.ndarray, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The voxels within radius of each centre, end to end in order, and where each centre's begin."""
    r = math.floor(radius + 1e-9)
    steps = np.array([s for s in itertools.product(range(-r, r + 1), repeat=3) if sum(x * x for x in s) <= radius * radius + 1e-9])
    found = Grid(points).find((points[centres][:, None, :].astype(np.int64) + steps).reshape(-1, 3)).reshape(len(centres), -1)
    found = np.sort(np.where(found < 0, len(points), found), axis=1)
    there = found < len(points)
    return found[there], np.concatenate([[0], np.cumsum(there.sum(axis=1))])


class Box:
    """The box around a grid's voxels, with a margin: sums over neighbours are sums of shifted boxes, without neighbour lists."""

    def __init__(self, points: np.ndarray, radius: float) -> None:
        self.margin = r = math.floor(radius + 1e-9)
        self.inner = tuple(int(n) for n in np.ptp(points, axis=0) + 1)
        if 8 * math.prod(n + 2 * r for n in self.inner) > SENT_BYTES:
            raise ValueError("the voxels' box is larger than tasks can hold")
        self.at = tuple((points - points.min(axis=0)).astype(np.int64).T)
        self.steps = [s for s in itertools.product(range(-r, r + 1), repeat=3) if sum(x * x for x in s) <= radius * radius + 1e-9]

    def around(self, x: np.ndarray, weights: Sequence[float]) -> np.ndarray:
        """For each voxel the sum of x, a number a voxel, over its neighbours, times the weights of the steps to them."""
        r = self.margin
        box = np.pad(np.zeros(self.inner), r)
        box[tuple(a + r for a in self.at)] = x
        total = np.zeros(self.inner)
        for (a, b, c), w in zip(self.steps, weights, strict=True):
            total += w * box[r + a : r + a + self.inner[0], r + b : r + b + self.inner[1], r + c : r + c + self.inner[2]]
        return total[self.at]


def _neighbour_means(images: DataFrame, voxels: DataFrame, radius: float, weight, values: str, counted: str | None) -> DataFrame:
    """images with weighted means over neighbours for values; weight is a function of a step's squared length."""
    points = coordinates(voxels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        box = Box(points, radius)
        weights = [weight(sum(x * x for x in s)) for s in box.steps]
        ones = [1.0] * len(weights)
        whole = box.around(np.ones(len(points)), weights), box.around(np.ones(len(points)), ones)
        for batch in batches:
            means, counts = [], []
            for v in batch[values]:
                if v is None:
                    means.append(None)
                    counts.append(None)
                    continue
                x = np.asarray(v, float)
                if len(x) != len(points):
                    raise ValueError("a vector of another length than its grid")
                there = ~np.isnan(x)
                share, n = whole if there.all() else (box.around(there, weights), box.around(there, ones))
                total = box.around(np.where(there, x, 0.0), weights)
                means.append([t / s if m else None for t, s, m in zip(total, share, n, strict=True)] if (n == 0).any() else total / share)
                counts.append(np.rint(n).astype(np.int64))
            yield batch.assign(**{values: means}, **({counted: counts} if counted else {}))

    fields = [T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == values else f for f in images.schema]
    return images.mapInPandas(run, T.StructType([*fields, *([T.StructField(counted, T.ArrayType(T.LongType()))] if counted else [])]))


def smooth(images: DataFrame, voxels: DataFrame, fwhm: float, reach: float = 3.0, values: str = "values") -> DataFrame:
    """images smoothed by Gaussian weights of the voxels in reach, which sum to one inside the mask.

    One pass, no shuffle and no row a voxel: a task holds the coordinates (size checked) and a box of one image. Null and
    NaN elements are left out of sum and weights, so smoothing fills them; null where nothing is in reach. A null
    vector stays null; one of another length than the grid is an error. An empty table gives an empty one.
    """
    if fwhm <= 0:
        raise ValueError("fwhm is positive")
    sigma = fwhm / math.sqrt(8 * math.log(2))
    return _neighbour_means(images, voxels, reach, lambda d2: math.exp(-d2 / (2 * sigma * sigma)), values, None)


def searchlight_means(images: DataFrame, voxels: DataFrame, radius: float, values: str = "values", counted: str = "n") -> DataFrame:
    """images with each sphere's mean for values, and the number of elements it is of in the array `counted`.

    As `smooth`, with equal weights. Null and NaN elements count nowhere; a sphere of nothing else is null, its count 0.
    """
    return _neighbour_means(images, voxels, radius, lambda d2: 1.0, values, counted)


class Spheres:
    """Distances of pairs of rows in the spheres of some centres, a tile of pairs at a time."""

    def __init__(self, x: np.ndarray, listed: np.ndarray, begin: np.ndarray, metric: str) -> None:
        self.x, self.metric = np.ascontiguousarray(x.T), metric  # voxels by rows
        self.members = [listed[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]

    def _over(self, values: np.ndarray, c: int) -> np.ndarray:
        first, *more = self.members[c]
        total = values[first].copy()
        for m in more:
            total += values[m]
        return total

    def squares(self, p: np.ndarray, q: np.ndarray) -> Iterator[np.ndarray]:
        """For each centre the squared Euclidean distances of all rows p to all rows q, by products; those of near rows by their differences.
        The table is overwritten by the next one."""
        x, y, made = self.x[:, p], self.x[:, q], np.empty((len(p), len(q)))
        flat = made.reshape(-1)
        for own in self.members:
            a, b = x[own], y[own]
            na, nb = (a * a).sum(axis=0), (b * b).sum(axis=0)
            # the products of a and -2 b, and both squares, come out of one multiplication
            np.matmul(np.vstack([a, na, np.ones(len(p))]).T, np.vstack([-2 * b, np.ones(len(q)), nb]), out=made)
            bound = 1e-6 * (na.max() + nb.max())
            if made.min() < bound:
                near = np.flatnonzero(flat < bound)
                m, n = np.divmod(near, len(q))
                flat[near] = ((a[:, m] - b[:, n]) ** 2).sum(axis=0)
            yield made

    def distances(self, p: np.ndarray, q: np.ndarray) -> Iterator[np.ndarray]:
        """For each centre the distances of rows p to rows q, one by one."""
        a, b = self.x[:, p], self.x[:, q]
        made = (a - b) ** 2 if self.metric == "euclidean" else a * b
        for c, own in enumerate(self.members):
            if self.metric == "euclidean":
                yield np.sqrt(self._over(made, c))
                continue
            n, s = len(own), self._over(self.x, c)
            var = self._over(self.x * self.x, c) - s * s / n
            both = var[p] * var[q]
            product = self._over(made, c) - s[p] * s[q] / n
            yield 1 - np.divide(product, np.sqrt(np.maximum(both, 1e-300)), out=np.zeros_like(product), where=both > 1e-20)


def _sphere_cells(images: DataFrame, points: np.ndarray, radius: float, metric: str, key: str, values: str, by: str | None) -> tuple[GroupedData, Callable, list[np.ndarray]]:
    """Images cut by pieces of CENTRES centres, grouped in cells; a function from a cell's batches to (cell, its spheres, its tiles of pairs
    of rows); and the pieces."""
    if metric not in ("euclidean", "correlation"):
        raise ValueError(f"metric is euclidean or correlation, not {metric!r}")
    pieces = [np.arange(a, min(a + CENTRES, len(points))) for a in range(0, len(points), CENTRES)]
    kind = dict(images.dtypes)[key]

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach = [np.unique(neighbour_lists(points, c, radius)[0]) for c in pieces]
        for batch in batches:
            for n, own in enumerate(reach):
                if len(batch):
                    yield pd.DataFrame({"id": batch[key], "piece": n, "named": batch["named"], "x": [np.asarray(v, float)[own] for v in batch[values]]})

    named = F.col(by).cast("string") if by else F.lit(None).cast("string")
    rows = images.select(key, values, named.alias("named")).mapInPandas(sent, f"id {kind}, piece int, named string, x array<double>")
    width = max(len(np.unique(neighbour_lists(points, c, radius)[0])) for c in pieces)

    def opened(batches: Iterator[pa.RecordBatch]) -> tuple[pairs.Cell, Spheres, Iterator]:
        cell = pairs.Cell(batches, "id")
        listed, begin = neighbour_lists(points, pieces[cell.held["piece"][0].as_py()], radius)
        x, whole = cell.vectors("x")
        if not whole.all():
            raise ValueError("images hold null values")
        return cell, Spheres(x, np.searchsorted(np.unique(listed), listed), begin, metric), cell.tiles(IMAGES * IMAGES, IMAGES)

    return pairs.cells(rows, "id", pairs.block_count(images.count(), width), "piece"), opened, pieces


def searchlight_distances(images: DataFrame, voxels: DataFrame, radius: float, metric: str = "euclidean", key: str = "image_id", values: str = "values") -> DataFrame:
    """center_id, i, j, value: the distance of each pair of images, i < j by key, in each sphere.

    metric "euclidean" or "correlation" (1 - r; 1 where a side is constant). Blocks of images meet for each piece of CENTRES
    centres, sent the voxels of its centres' spheres alone (`pairs`). The result has, by its nature, a row for each centre
    and pair. Keys are distinct; null values are errors. One image: empty result.
    """
    cells, opened, pieces = _sphere_cells(images, coordinates(voxels), radius, metric, key, values, None)
    kind = dict(images.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, spheres, tiles = opened(batches)
        centres = pieces[cell.held["piece"][0].as_py()]
        for a, b, there in tiles:
            p, q = (side[at] for side, at in zip((a, b), np.nonzero(there), strict=True))
            low, high = (pa.array(f(cell.ids[p], cell.ids[q])) for f in (np.minimum, np.maximum))
            for c, made in zip(centres, spheres.distances(p, q), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), c, np.int32)), low, high, pa.array(made)], names=["center_id", "i", "j", "value"])

    return cells.applyInArrow(run, f"center_id int, i {kind}, j {kind}, value double")


def _stretches(code: np.ndarray, most: int) -> list[slice]:
    """Stretches of `most` rows at most of codes in order, cut where a code of many rows begins or ends."""
    begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    end = np.r_[begin[1:], len(code)][: len(begin)]
    many = 2 * (end - begin) >= most
    cuts = np.unique(np.r_[0, len(code), begin[many], end[many]])
    return [slice(a, min(a + most, y)) for x, y in itertools.pairwise(cuts.tolist()) for a in range(x, y, most)]


def _named_tiles(cell: pairs.Cell, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray | None]]]]:
    """Rows of one side and of the other, and the parts of their table that are pairs: 1 of one name or 0 of two, and their places (None: all of it).
    Rows go in the order of their names, so that most tables are one part."""
    left, right = (side[np.argsort(code[side], kind="stable")] for side in (cell.left, cell.right))
    for a in _stretches(code[left], IMAGES):
        for b in _stretches(code[right], ACROSS):
            p, q = left[a], right[b]
            there = cell.ids[p][:, None] != cell.ids[q]
            if cell.one:  # both sides are the same rows, of which each pair is met once
                there &= np.arange(a.start, a.stop)[:, None] < np.arange(b.start, b.stop)
            same = code[p][:, None] == code[q]
            met = [(k, has, np.count_nonzero(has)) for k, has in ((1, there & same), (0, there & ~same))]
            if parts := [(k, None if n == has.size else np.flatnonzero(has)) for k, has, n in met if n]:
                yield p, q, parts


def searchlight_distance_summary(
    images: DataFrame, voxels: DataFrame, radius: float, by: str, metric: str = "euclidean", key: str = "image_id", values: str = "values"
) -> DataFrame:
    """center_id, same, pairs, mean, nearest, farthest: searchlight_distances of the pairs of one value of `by` (nulls are one) and of two.

    As searchlight_distances, but that a task sums up its pairs: no row is made for a pair.
    """
    cells, opened, pieces = _sphere_cells(images, coordinates(voxels), radius, metric, key, values, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, spheres, tiles = opened(batches)
        centres = pieces[cell.held["piece"][0].as_py()]
        code = pa.concat_arrays(cell.held["named"].chunks).dictionary_encode(null_encoding="encode").indices.to_numpy()
        n = np.zeros(2, np.int64)
        sums, least, most = np.zeros((len(centres), 2)), np.full((len(centres), 2), np.inf), np.full((len(centres), 2), -np.inf)

        def add(c: int, k: int, made: np.ndarray) -> None:
            sums[c, k] += made.sum()
            least[c, k], most[c, k] = min(least[c, k], made.min()), max(most[c, k], made.max())

        for p, q, parts in _named_tiles(cell, code) if metric == "euclidean" else ():
            for k, at in parts:
                n[k] += len(p) * len(q) if at is None else len(at)
            for c, made in enumerate(spheres.squares(p, q)):
                for k, at in parts:
                    own = made.reshape(-1) if at is None else made.reshape(-1)[at]
                    add(c, k, np.sqrt(own, out=own))
        for p, q, there in tiles if metric != "euclidean" else ():
            i, j = np.nonzero(there)
            p, q = p[i], q[j]
            same = code[p] == code[q]
            order = np.argsort(~same, kind="stable")
            parts = [(k, part) for k, part in ((1, slice(0, same.sum())), (0, slice(same.sum(), len(p)))) if part.stop > part.start]
            for k, part in parts:
                n[k] += part.stop - part.start
            for c, made in enumerate(spheres.distances(p[order], q[order])):
                for k, part in parts:
                    add(c, k, made[part])
        for k in np.flatnonzero(n):
            columns = [pa.array(centres.astype(np.int32)), pa.array(np.full(len(centres), bool(k))), pa.array(np.full(len(centres), n[k]))]
            names = ["center_id", "same", "n", "s", "least", "most"]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(m[:, k])) for m in (sums, least, most))], names=names)

    parts = cells.applyInArrow(run, "center_id int, same boolean, n long, s double, least double, most double")
    mean = F.sum("s") / F.sum("n")
    return parts.groupBy("center_id", "same").agg(F.sum("n").alias("pairs"), mean.alias("mean"), F.min("least").alias("nearest"), F.max("most").alias("farthest"))


def resampling_weights(source: np.ndarray, source_affine: np.ndarray, target: np.ndarray, target_affine: np.ndarray, how: str = "linear") -> tuple[np.ndarray, np.ndarray]:
    """(source voxel, weight) of each target voxel: 8 columns of trilinear neighbours, or 1 of the nearest.

    Affines map i, j, k to millimetres. A neighbour that the source does not have counts as 0 (weight 0).
    """
    places = np.c_[target, np.ones(len(target))] @ (np.linalg.inv(source_affine) @ target_affine).T
    places = np.round(places[:, :3], 9)
    grid = Grid(source)
    if how == "nearest":
        at = grid.find(np.floor(places + 0.5).astype(np.int64))[:, None]
        return np.maximum(at, 0), (at >= 0).astype(float)
    if how != "linear":
        raise ValueError(f"how is linear or nearest, not {how!r}")
    base = np.floor(places).astype(np.int64)
    part = places - base
    at, weight = np.empty((len(target), 8), np.int64), np.empty((len(target), 8))
    for m, step in enumerate(itertools.product((0, 1), repeat=3)):
        at[:, m] = grid.find(base + np.array(step))
        weight[:, m] = np.prod(np.where(step, part, 1 - part), axis=1)
    return np.maximum(at, 0), np.where(at >= 0, weight, 0.0)


def resample(
    images: DataFrame, source: DataFrame, source_affine: Sequence[Sequence[float]], target: DataFrame, target_affine: Sequence[Sequence[float]], how: str = "linear", values: str = "values"
) -> DataFrame:
    """images with their values on the target grid: vectors over target's voxels in order.

    One pass, no shuffle: the weights (12 bytes a target voxel and neighbour, size checked) are a sparse matrix in every task.
    What lies outside the source is 0. A null vector stays null; a vector of another length than the source is an error.
    """
    from_, to = coordinates(source), coordinates(target)
    at, weight = resampling_weights(from_, np.asarray(source_affine, float), to, np.asarray(target_affine, float), how)
    if at.nbytes + weight.nbytes > SENT_BYTES:
        raise ValueError("more target voxels than tasks can hold the weights of")
    at = at.astype(np.int32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for v in batch[values]:
                if v is not None and len(v) != len(from_):
                    raise ValueError("a vector of another length than its grid")
                x = None if v is None else np.asarray(v, float)
                out.append(None if x is None else sum(weight[:, m] * x[at[:, m]] for m in range(at.shape[1])))
            yield batch.assign(**{values: out})

    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == values else f for f in images.schema])
    return images.mapInPandas(run, schema)
