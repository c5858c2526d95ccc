"""Sides of joins that go to all tasks only where their size allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, of a few numbers each, that a side of a join may have to be sent to all tasks: some 64 MB.
SENT_ROWS = 1 << 20


def sent(frame: DataFrame) -> DataFrame:
    """frame, marked to be sent to all tasks if it has SENT_ROWS rows at most; counted by a job that stops beyond them.
    A larger one meets the other side by a shuffle: left to sizes on disk, Spark may send either side, whatever its rows."""
    return F.broadcast(frame) if frame.limit(SENT_ROWS + 1).count() <= SENT_ROWS else frame.hint("merge")
