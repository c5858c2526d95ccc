"""Sums of small matrices over the rows of a table, added up on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums that one task adds up, and the most that the driver gets.
FAN = 8
#: Numbers in a row of a partial sum.
CELLS = 1 << 20


def _rows(total: np.ndarray) -> pd.DataFrame:
    flat = total.reshape(-1)
    cuts = range(0, max(1, len(flat)), CELLS)
    return pd.DataFrame({"shape": [list(total.shape)] * len(cuts), "at": list(cuts), "flat": [flat[c : c + CELLS] for c in cuts]})


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, shapes = {}, {}
    for batch in batches:
        for shape, at, flat in batch.itertuples(index=False):
            held[at] = held[at] + flat if at in held else np.array(flat, float)
            shapes[at] = list(shape)
    if held:
        yield pd.DataFrame({"shape": list(shapes.values()), "at": list(held), "flat": list(held.values())})


def sum_arrays(frame: DataFrame, function: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray | None:
    """The sum of function(batch) over all batches of the frame's rows; None of an empty table.

    A task adds up its own; partial sums then meet FAN at a time in further tasks, so the driver gets
    about FAN matrices, whatever the number of tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                made = function(batch)
                total = made if total is None else total + made
        if total is not None:
            yield _rows(np.asarray(total, float))

    parts = frame.mapInPandas(run, "shape array<int>, at long, flat array<double>")
    left = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while left > FAN:
        left = -(-left // FAN)
        parts = parts.repartition(left).mapInPandas(_added, "shape array<int>, at long, flat array<double>")
    total = None
    for row in parts.toLocalIterator():
        if total is None:
            total = np.zeros(row["shape"])
        piece = np.asarray(row["flat"], float)
        total.reshape(-1)[row["at"] : row["at"] + len(piece)] += piece
    return total


def _keyed_rows(key: object, part: int, total: np.ndarray, cells: int) -> pd.DataFrame:
    wide = total.reshape(total.shape[0], -1)
    cuts = range(0, max(1, wide.shape[1]), cells)
    return pd.DataFrame({"key": [key] * len(cuts), "part": [part] * len(cuts), "at": list(cuts), "flat": [wide[:, c : c + cells].reshape(-1) for c in cuts]})


def _keyed_added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict = {}
    for batch in batches:
        for key, part, at, flat in batch.itertuples(index=False):
            held[key, part, at] = held[key, part, at] + flat if (key, part, at) in held else np.array(flat, float)
    if held:
        keys, parts, cuts = zip(*held, strict=True)
        yield pd.DataFrame({"key": list(keys), "part": list(parts), "at": list(cuts), "flat": list(held.values())})


def sum_arrays_by(frame: DataFrame, kind: str, function: Callable[[Iterator[pd.DataFrame]], Iterator[tuple[object, np.ndarray]]], cells: int = 4096) -> DataFrame:
    """key, at, flat: the sums, for each key of type `kind`, of the (key, matrix) pairs that function makes of a task's
    batches, cut into pieces of `cells` columns beginning at column `at`, row by row in flat.

    Partial sums of a key meet FAN at a time on the executors; nothing passes the driver, and a task holds
    pieces of sums alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for key, total in function(batches):
            yield _keyed_rows(key, part, np.asarray(total, float), cells)

    schema = f"key {kind}, part long, at long, flat array<double>"
    parts = frame.mapInPandas(run, schema)
    left = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while left > 1:
        left = -(-left // FAN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).repartition("key", "at", "part").mapInPandas(_keyed_added, schema)
    # tasks beyond the shuffle's number of partitions leave more than one part: the rest of them meet by key
    return parts.withColumn("part", F.lit(0).cast("long")).repartition("key", "at").mapInPandas(_keyed_added, schema).drop("part")
