"""Connected components as joins and minima, for link tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _hop(labels: DataFrame, onto: DataFrame) -> DataFrame:
    """labels(node, comp) with each comp replaced by what `onto`(hi, lo) says of it."""
    return labels.join(onto, labels["comp"] == onto["hi"], "left").select("node", F.coalesce("lo", "comp").alias("comp"))


def connected_components(links: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """links(a, b) to (node, comp): comp is the smallest node reachable, the node itself included.

    Each round hooks every label onto the smallest one linked with it, follows those hooks twice
    more, and contracts the links; a star takes one round, a path of n nodes a logarithmic number.
    Nodes without links do not appear. Null ends are left out. Only counts reach the driver. Tables
    between rounds, and the result, are in scratch; links are read twice more to count them, so they
    should be a saved table. Raises if links do not settle in max_rounds.
    """
    n = links.count()
    links = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node"))
    edges = scratch.save(edges, "edges", n)
    for _ in range(max_rounds):
        left = edges.count()
        if not left:
            return labels
        hooks = scratch.save(edges.groupBy("hi").agg(F.min("lo").alias("lo")), "hooks", left)
        for _ in range(2):
            nxt = hooks.select(F.col("hi").alias("at"), F.col("lo").alias("to"))
            hooks = hooks.join(nxt, hooks["lo"] == nxt["at"], "left").select("hi", F.coalesce("to", "lo").alias("lo"))
        hooks = scratch.save(hooks, "hooks", left)
        labels = scratch.save(_hop(labels, hooks), "labels", 2 * n)
        ends = edges
        for end in ("hi", "lo"):
            onto = hooks.select(F.col("hi").alias("at"), F.col("lo").alias("to"))
            ends = ends.join(onto, ends[end] == onto["at"], "left").withColumn(end, F.coalesce("to", end)).drop("at", "to")
        edges = scratch.save(
            ends.filter("hi != lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "edges", left
        )
    raise RuntimeError(f"links did not settle in {max_rounds} rounds")
