"""Pairs of rows as blocks: two blocks of vectors meet in a task as arrays, and their pairs leave it tile by tile.

All pairs are quadratic by nature, their making need not be: a row is sent once to each block of the other side, a task holds the vectors of two blocks and one tile of pairs, and a pair's number comes
out of array operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

#: Numbers and rows of a block at most, about; blocks that rows are dealt to at least, if there are as many DEALT_ROWS.
NUMBERS, ROWS, DEALT, DEALT_ROWS = 1 << 23, 1 << 14, 12, 256
#: Pairs of a tile, of which a task holds one at a time; and its columns.
TILE, WIDE = 1 << 17, 1 << 11
#: Pairs that a task holds at a time to put them in the order of their values, and pairs of a value, on average, from which on it does.
SORTED, ALIKE = 1 << 24, 4
#: Bits of a place among them; and different values up to which columnar files number them in whatever order they come.
PLACES, NUMBERED = 25, 1 << 16
#: Pairs that stay in a core's cache while passes go over them, and their columns.
CACHED, CACHED_WIDE = 1 << 14, 1 << 11
#: Tasks that cells, which are pairs of blocks, are dealt to at most.
TASKS = 2048

#: Numbers of all pairs, rows of x times rows of y; or several such, one for each region.
Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]


def rounded(value: np.ndarray, digits: int = 6) -> np.ndarray:
    """Halves away from zero, without a negative zero; null (NaN) stays."""
    value = np.asarray(value, float)
    if value.size <= CACHED:
        return _rounded(value, digits)
    flat = value.reshape(-1)
    made = np.empty(flat.shape)
    for at in range(0, len(flat), CACHED):
        made[at : at + CACHED] = _rounded(flat[at : at + CACHED], digits)
    return made.reshape(value.shape)


def _rounded(value: np.ndarray, digits: int) -> np.ndarray:
    scaled = value * 10.0**digits
    whole = np.trunc(scaled)
    return (whole + np.sign(scaled) * (np.abs(scaled - whole) >= 0.5)) / 10.0**digits + 0.0


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x @ y.T


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of centred or plain rows; 0 where a side is 0."""
    size = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))
    return np.divide(x @ y.T, size, out=np.zeros(size.shape), where=size > 0)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _shared(x, y)


def correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """0 where a side is constant."""
    return _shared(_centred(x), _centred(y))


def _centred(x: np.ndarray) -> np.ndarray:
    made = x - x.mean(axis=1, keepdims=True)
    made[np.ptp(x, axis=1) == 0] = 0.0
    return made


def _gaps(x: np.ndarray, y: np.ndarray, add: Callable[[np.ndarray, np.ndarray], None], elements: range) -> np.ndarray:
    """add(total, difference) over elements, whose differences are made one element at a time, of as many pairs as stay in a core's cache."""
    total, across = np.zeros((len(x), len(y))), np.ascontiguousarray(y.T)
    wide = max(1, min(CACHED_WIDE, len(y)))
    tall = max(1, CACHED // wide)
    for a in range(0, len(x), tall):
        for b in range(0, len(y), wide):
            here = x[a : a + tall]
            part = np.zeros((len(here), min(wide, len(y) - b)))
            gap = np.empty(part.shape)
            for k in elements:
                np.subtract(here[:, k, None], across[k, b : b + wide], out=gap)
                add(part, gap)
            total[a : a + tall, b : b + wide] = part
    return total


def _add_square(total: np.ndarray, gap: np.ndarray) -> None:
    np.multiply(gap, gap, out=gap)
    np.add(total, gap, out=total)


def _add_size(total: np.ndarray, gap: np.ndarray) -> None:
    np.abs(gap, out=gap)
    np.add(total, gap, out=total)


def _keep_largest(total: np.ndarray, gap: np.ndarray) -> None:
    np.abs(gap, out=gap)
    np.maximum(total, gap, out=total)


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(_gaps(x, y, _add_square, range(x.shape[1])))


def cityblock(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _gaps(x, y, _add_size, range(x.shape[1]))


def chebyshev(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _gaps(x, y, _keep_largest, range(x.shape[1]))


SIMILARITIES: dict[str, Measure] = {"dot": products, "cosine": cosines, "correlation": correlations}
DISTANCES: dict[str, Measure] = {
    "euclidean": euclidean,
    "cityblock": cityblock,
    "chebyshev": chebyshev,
    "cosine": lambda x, y: 1 - cosines(x, y),
    "correlation": lambda x, y: 1 - correlations(x, y),
}


def regional_euclidean(width: int) -> Measure:
    """Distances in each run of `width` elements: regions times rows of x times rows of y."""

    def made(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(_gaps(x, y, _add_square, range(a, min(a + width, x.shape[1])))) for a in range(0, x.shape[1], width)])

    return made


def block_count(n: int, width: int = 1, groups: int = 1) -> int:
    """Blocks of n rows of `width` numbers: no larger than a task holds, and enough of them for tasks to share the pairs of all groups."""
    least = max(1, round(DEALT / groups**0.5))
    return max(1, -(-n // ROWS), -(-n * width // NUMBERS), min(least, -(-n // DEALT_ROWS)))


def cells(frame: DataFrame, key: str, blocks: int, *by: str) -> GroupedData:
    """frame's rows once for each cell (low_, high_), low_ <= high_, of their own block_ and another, within `by`: the groups to make pairs in."""
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    sent = frame.filter(F.col(key).isNotNull()).withColumn("block_", own).withColumn("other_", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = sent.withColumns({"low_": F.least("block_", "other_"), "high_": F.greatest("block_", "other_")}).drop("other_")
    on = [*by, "low_", "high_"]
    return met.repartition(max(min(TASKS, blocks * (blocks + 1) // 2), int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *on).groupBy(*on)


class Cell:
    """What a task has of a cell, as columns; its pairs come tile by tile, each one once and only of different keys."""

    def __init__(self, batches: Iterator[pa.RecordBatch], key: str) -> None:
        self.held = pa.Table.from_batches(batches)
        self.ids, own = self.column(key), self.column("block_")
        low, high = self.held["low_"][0].as_py(), self.held["high_"][0].as_py()
        self.one = low == high
        sides = (np.flatnonzero(own == low), np.flatnonzero(own == high))
        self.left, self.right = (s[np.argsort(self.ids[s], kind="stable")] for s in sides)

    def column(self, name: str) -> np.ndarray:
        return self.held[name].to_numpy()

    def vectors(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Rows of numbers, and which of them have all of theirs; what is null is 0."""
        rows = pa.concat_arrays(self.held[name].chunks)
        whole, flat = rows.is_valid().to_numpy(zero_copy_only=False), rows.flatten()
        x = np.zeros((len(rows), len(flat) // max(1, whole.sum())))
        x[whole] = flat.fill_null(0.0).to_numpy().reshape(-1, x.shape[1])
        if flat.null_count:
            whole[whole] = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, x.shape[1]).all(axis=1)
        return x, whole

    def tiles(self, pairs: int = TILE, wide: int = WIDE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of one side and of the other, and which of their pairs are there."""
        if not len(self.left) or not len(self.right):  # a block without rows, or none of this group
            return
        wide = min(wide, len(self.right), pairs)
        tall = pairs // max(1, wide)
        for a in range(0, len(self.left), tall):
            for b in range(0, len(self.right), wide):
                p, q = self.left[a : a + tall], self.right[b : b + wide]
                if self.one and self.ids[p[0]] >= self.ids[q[-1]]:
                    continue  # all of it is met the other way round
                yield p, q, self.ids[p][:, None] < self.ids[q] if self.one else np.ones((len(p), len(q)), bool)


def _table(x: np.ndarray, y: np.ndarray, there: np.ndarray, measure: Measure, digits: int) -> np.ndarray:
    """The measure of all rows x with all rows y, rounded, tile by tile; what is not there may be left out."""
    made = np.zeros(there.shape)
    wide = min(WIDE, len(y))
    for a in range(0, len(x), TILE // wide):
        for b in range(0, len(y), wide):
            here = np.s_[a : a + TILE // wide, b : b + wide]
            if there[here].any():
                made[here] = rounded(measure(x[here[0]], y[here[1]]), digits)
    return made


def _by_value(made: np.ndarray, at: np.ndarray | None, digits: int) -> np.ndarray | None:
    """Places `at` (None: all) in the order of what is made there, if its values are many and come again so often that columnar files,
    which write a value that comes again at once in a few bits, get smaller by it; keys out of order take them two bytes each."""
    own = made if at is None else made[at]
    low, high = (float(f(own, initial=0.0)) for f in (np.min, np.max))
    if not (high - low) * 10.0**digits < 1 << 62 - PLACES:  # nor if one is not finite
        return at
    order = np.empty(len(own), np.int64)
    for k in range(0, len(own), TILE):
        code = np.rint((own[k : k + TILE] - low) * 10.0**digits).astype(np.int64) << PLACES
        order[k : k + TILE] = code + (np.arange(k, k + len(code)) if at is None else at[k : k + TILE])
    order.sort()
    parts = (order[max(0, k - 1) : k + TILE] >> PLACES for k in range(0, len(order), TILE))
    kinds = 1 + sum(np.count_nonzero(x[1:] != x[:-1]) for x in parts)
    if kinds <= NUMBERED or ALIKE * kinds > len(order):
        return at
    order &= (1 << PLACES) - 1
    return order


def image_pairs(frame: DataFrame, measure: Measure, digits: int = 6, region: str | None = None, key: str = "image_id", values: str = "values") -> DataFrame:
    """i, j, value: the measure of each pair of rows, i < j by key, rounded; with `region`, its number first and a row for
    each region that the measure gives.

    Keys are whole numbers; rows of equal keys make no pair. Vectors have one length; the value is null where one is null or
    has null elements. The result has, by its nature, a row for each pair.
    """
    rows = frame.select(key, F.col(values).cast("array<double>").alias("x_"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("x_")), F.lit(1)).alias("width")).first()
    names = [*([region] if region else []), "i", "j", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = Cell(batches, key)
        x, whole = cell.vectors("x_")
        slabs = max(1, -(-len(cell.left) * len(cell.right) // SORTED))  # of one size, about
        for a, b, there in cell.tiles() if region else cell.tiles(-(-len(cell.left) // slabs) * len(cell.right), len(cell.right)):
            tables = measure(x[a], x[b]) if region else [_table(x[a], x[b], there, measure, digits)]
            for n, table in enumerate(tables):
                at = np.flatnonzero(there) if cell.one else None  # every pair of two blocks is there
                made = (rounded(table, digits) if region else table).reshape(-1)
                order = at if region else _by_value(made, at, digits)
                for k in range(0, made.size if order is None else len(order), TILE):
                    part = np.arange(k, min(k + TILE, made.size)) if order is None else order[k : k + TILE]
                    p, q = np.divmod(part, len(b))
                    p, q = a[p], b[q]
                    first, second, lost = cell.ids[p], cell.ids[q], ~(whole[p] & whole[q])
                    number = [np.full(len(part), n)] if region else []
                    value = pa.array(made[part], mask=lost if lost.any() else None)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (*number, np.minimum(first, second), np.maximum(first, second))), value], names=names)

    schema = ", ".join(f"{c} {'double' if c == 'value' else 'long'}" for c in names)
    return cells(rows, key, block_count(size["n"], max(1, size["width"]))).applyInArrow(run, schema)


def differences(frame: DataFrame, x: str, y: str, group: str, key: str, digits: int | None = None) -> DataFrame:
    """group, ka, kb, dx, label: of each pair of a group's rows with different y, ka < kb by key, the difference of x and the sign
    of that of y, as doubles. A group may be of any size. Rows without key, group or y make no pair; dx is null where an x is."""
    kind = dict(frame.dtypes)[group]
    rows = frame.select(F.col(group).alias("group_"), F.col(key).alias("key_"), F.col(x).cast("double").alias("x_"), F.col(y).cast("double").alias("y_")).dropna(subset=["group_", "y_"])
    sizes = rows.groupBy("group_").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("groups")).first()
    names = [group, "ka", "kb", "dx", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = Cell(batches, "key_")
        name = cell.held["group_"][0].as_py()
        kept = cell.held.schema.field("group_").type
        there_x = cell.held["x_"].is_valid().to_numpy()
        v, w = cell.held["x_"].fill_null(0.0).to_numpy(), cell.column("y_")
        for a, b, there in cell.tiles():
            p, q = np.nonzero(there & (w[a][:, None] != w[b]))
            p, q = a[p], b[q]
            if not cell.one:
                turned = cell.ids[p] > cell.ids[q]
                p, q = np.where(turned, q, p), np.where(turned, p, q)
            dx = v[p] - v[q]
            dx = pa.array(dx if digits is None else rounded(dx, digits), mask=~(there_x[p] & there_x[q]))
            columns = [pa.repeat(pa.scalar(name, kept), len(p)), pa.array(cell.ids[p]), pa.array(cell.ids[q]), dx, pa.array(np.sign(w[p] - w[q]))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = dict(frame.dtypes)
    blocks = block_count(sizes["n"] or 0, 1, sizes["groups"] or 1)
    return cells(rows, "key_", blocks, "group_").applyInArrow(run, f"{group} {kind}, ka {kinds[key]}, kb {kinds[key]}, dx double, label double")
