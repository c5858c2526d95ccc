"""Connected regions of images as joins: components and the basins of peaks, for images of any size.

long(image_id, voxel_id, value); voxels(voxel_id, i, j, k). A voxel meets its neighbours by an equi-join on shifted
grid cells within its image. Labels settle by minima over links and by following labels of labels, so a
region that is n voxels long takes a number of rounds that grows with the logarithm of n.

Tables with a row a voxel meet by shuffles alone (`_large`): as Parquet they are a few MB where their rows, sent to all tasks,
fill the driver, so their size on disk must not decide. Of the grid rows are counted: it alone may go to all tasks.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sizes import sent
from tessera.sources.scratch import Scratch, keep

#: Half of the 26 steps to a neighbour, one of each pair of opposite ones; and all of them.
HALF = [s for s in itertools.product((-1, 0, 1), repeat=3) if s > (0, 0, 0)]
ALL = [s for s in itertools.product((-1, 0, 1), repeat=3) if s != (0, 0, 0)]


def _large(side: DataFrame) -> DataFrame:
    """side, marked to meet the other side of a join by a shuffle, whatever its size on disk."""
    return side.hint("merge")


def placed(long: DataFrame, voxels: DataFrame, threshold: float) -> DataFrame:
    """image_id, voxel_id, value, sign and i, j, k of the voxels with |value| >= threshold and a place in the grid."""
    kept = long.filter(F.abs("value") >= threshold).select("image_id", "voxel_id", "value", F.signum("value").alias("sign"))
    return kept.join(sent(voxels.select("voxel_id", "i", "j", "k")), "voxel_id")


def neighbours(rows: DataFrame, steps: list[tuple[int, int, int]]) -> DataFrame:
    """image_id, a, value_a, b, value_b: pairs of placed voxels of one image and sign that are a step apart."""
    moves = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip("xyz", s, strict=True)]) for s in steps])
    here = rows.select("image_id", F.col("voxel_id").alias("a"), F.col("value").alias("value_a"), "sign", "i", "j", "k", F.explode(moves).alias("m"))
    at = here.select("image_id", "a", "value_a", "sign", *[(F.col(c) + F.col(f"m.{m}")).alias(c) for c, m in zip("ijk", "xyz", strict=True)])
    there = rows.select("image_id", F.col("voxel_id").alias("b"), F.col("value").alias("value_b"), "sign", "i", "j", "k")
    return at.join(_large(there), ["image_id", "sign", "i", "j", "k"]).select("image_id", "a", "value_a", "b", "value_b")


def _followed(labels: DataFrame, onto: DataFrame) -> DataFrame:
    """labels(image_id, node, to), each `to` replaced by where onto sends it."""
    nxt = onto.select("image_id", F.col("node").alias("to"), F.col("to").alias("further"))
    return labels.join(_large(nxt), ["image_id", "to"], "left").select("image_id", "node", F.coalesce("further", "to").alias("to"))


def components(nodes: DataFrame, links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """image_id, node, to: each node's smallest reachable node over links(image_id, a, b), itself without links.

    Each round hooks a label onto the smallest label that it is linked with, follows the hooks twice and
    contracts the links to labels. Tables of a round are in scratch; an error if links do not settle.
    """
    labels = scratch.save(nodes.select("image_id", "node", F.col("node").alias("to")))
    edges = scratch.save(links.select("image_id", F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct())
    for _ in range(rounds):
        if edges.isEmpty():
            return labels
        hooks = edges.groupBy("image_id", F.col("hi").alias("node")).agg(F.min("lo").alias("to"))
        hooks = scratch.save(hooks)
        for _ in range(2):
            hooks = _followed(hooks, hooks)
        hooks = scratch.save(hooks)
        labels = scratch.save(_followed(labels, hooks))
        ends = edges
        for end in ("hi", "lo"):
            onto = hooks.select("image_id", F.col("node").alias(end), F.col("to").alias("label"))
            ends = ends.join(_large(onto), ["image_id", end], "left").withColumn(end, F.coalesce("label", end)).drop("label")
        edges = scratch.save(ends.filter("hi <> lo").select("image_id", F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct())
    raise RuntimeError(f"regions did not settle in {rounds} rounds")


def _numbered(rows: DataFrame, min_size: int) -> DataFrame:
    """rows(image_id, region, voxel_id, value) of regions of min_size voxels, numbered as `cluster` from 1 by size, then region."""
    sizes = rows.groupBy("image_id", "region").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_size)
    order = Window.partitionBy("image_id").orderBy(F.col("size").desc(), "region")  # a row a region
    named = sizes.select("image_id", "region", F.row_number().over(order).cast("long").alias("cluster"))
    return rows.join(_large(named), ["image_id", "region"]).select("image_id", "cluster", "voxel_id", "value")


def clusters(long: DataFrame, voxels: DataFrame, threshold: float, min_size: int = 1) -> DataFrame:
    """image_id, cluster, voxel_id, value: 26-connected voxels of one sign with |value| >= threshold.

    Clusters of at least min_size voxels, numbered from 1 by size, ties by smallest voxel. Null and NaN values and
    voxels without a place are left out; an (image, voxel) is expected once. The result is a table in the
    shared folder (tessera.sources.scratch.drop removes it). No voxel over the threshold: empty result.
    """
    held = long.filter(~F.isnan("value"))
    with Scratch(long.sparkSession, "regions") as scratch:
        rows = scratch.save(placed(held, voxels, threshold))
        found = components(rows.withColumnRenamed("voxel_id", "node"), neighbours(rows, HALF), scratch)
        named = rows.join(_large(found.select("image_id", F.col("node").alias("voxel_id"), F.col("to").alias("region"))), ["image_id", "voxel_id"])
        return keep(_numbered(named, min_size))


def peak_regions(long: DataFrame, voxels: DataFrame, threshold: float, min_size: int = 1) -> DataFrame:
    """image_id, cluster, voxel_id, value, peak: the clusters cut into the basins of their local maxima of |value|.

    Each voxel climbs to the largest of its neighbours and itself (ties to the smaller voxel), and from there on; where
    it comes to rest is its peak. Basins of at least min_size voxels, numbered from 1 by size, ties by smallest peak voxel.
    As clusters() otherwise.
    """
    held = long.filter(~F.isnan("value"))
    with Scratch(long.sparkSession, "regions") as scratch:
        rows = scratch.save(placed(held, voxels, threshold))
        own = rows.select("image_id", F.col("voxel_id").alias("a"), F.col("voxel_id").alias("b"), F.col("value").alias("value_b"))
        pairs = neighbours(rows, ALL).select("image_id", "a", "b", "value_b").unionByName(own)
        best = F.min(F.struct((-F.abs("value_b")).alias("less"), F.col("b").alias("to")))
        climbs = scratch.save(pairs.groupBy("image_id", F.col("a").alias("node")).agg(best.alias("best")).select("image_id", "node", F.col("best.to").alias("to")))
        while True:  # each pass doubles the steps taken; a climb is at most as long as its image's voxels
            further = scratch.save(_followed(climbs, climbs))
            moved = further.join(_large(climbs), ["image_id", "node", "to"], "left_anti")
            climbs = further
            if moved.isEmpty():
                break
        named = rows.join(_large(climbs.select("image_id", F.col("node").alias("voxel_id"), F.col("to").alias("region"))), ["image_id", "voxel_id"])
        numbered = _numbered(named, min_size).join(_large(climbs.select("image_id", F.col("node").alias("voxel_id"), F.col("to").alias("peak"))), ["image_id", "voxel_id"])
        return keep(numbered)
