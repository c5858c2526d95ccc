"""Regions, spheres and resampling against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql.functions import col as spark_col

from tessera.operators import regions, searchlight, spatial


def plain_clusters(values, points, threshold, min_size):
    """Flood fill, image by image: (image, cluster, voxel)."""
    at = {tuple(p): v for v, p in enumerate(points)}
    out = set()
    for image, x in enumerate(values):
        left = {v for v in range(len(x)) if abs(x[v]) >= threshold}
        found = []
        while left:
            seed = min(left)
            region, edge = {seed}, [seed]
            left.discard(seed)
            while edge:
                v = edge.pop()
                for s in regions.ALL:
                    w = at.get(tuple(np.add(points[v], s)))
                    if w in left and np.sign(x[w]) == np.sign(x[v]):
                        left.discard(w)
                        region.add(w)
                        edge.append(w)
            found.append(sorted(region))
        found = sorted((r for r in found if len(r) >= min_size), key=lambda r: (-len(r), r[0]))
        out |= {(image, n + 1, v) for n, r in enumerate(found) for v in r}
    return out


def long_of(spark, values):
    rows = [(int(n), int(v), float(x)) for n, row in enumerate(values) for v, x in enumerate(row)]
    return spark.createDataFrame(rows, "image_id long, voxel_id int, value double").repartition(4)


def test_clusters_and_basins(spark):
    r = np.random.default_rng(1)
    points = np.array(list(itertools.product(range(6), repeat=3)))
    values = r.normal(size=(5, 216))
    values[0] = 1.0
    values[1] = 0.0
    # a winding path through the whole grid: long, so that labels must travel
    values[2] = 0
    values[2][[v for v, (i, j, k) in enumerate(points) if (j % 2 == 0 and i % 2 == 0) or (j % 2 == 1 and i % 2 == 0 and k == (5 if (j // 2) % 2 else 0)) or (i % 2 == 1 and j in (0, 4) and k == 0)]] = 2
    values[3][10] = np.nan
    for size in (1, 3):
        got = regions.clusters(long_of(spark, values), spatial.grid(spark, 6), 0.9, size)
        assert {(x["image_id"], x["cluster"], x["voxel_id"]) for x in got.collect()} == plain_clusters(np.nan_to_num(values), points, 0.9, size)
    assert regions.clusters(long_of(spark, values), spatial.grid(spark, 6), 99.0).collect() == []
    at = {tuple(p): v for v, p in enumerate(points)}

    def climb(x, v):
        while True:
            near = [w for s in [(0, 0, 0), *regions.ALL] if (w := at.get(tuple(np.add(points[v], s)))) is not None and abs(x[w]) >= 0.5 and np.sign(x[w]) == np.sign(x[v])]
            best = min(near, key=lambda w: (-abs(x[w]), w))
            if best == v:
                return v
            v = best

    smooth = np.stack([np.sin(points @ a) for a in r.normal(size=(3, 3))])
    got = regions.peak_regions(long_of(spark, smooth), spatial.grid(spark, 6), 0.5).collect()
    assert {(x["image_id"], x["voxel_id"]): x["peak"] for x in got} == {(n, v): climb(x, v) for n, x in enumerate(smooth) for v in range(216) if abs(x[v]) >= 0.5}


@pytest.mark.parametrize("metric", ["euclidean", "correlation"])
def test_searchlight_distances(spark, monkeypatch, metric):
    monkeypatch.setattr(searchlight, "IMAGES", 3)
    monkeypatch.setattr(searchlight, "CENTRES", 10)
    r = np.random.default_rng(2)
    points = np.array(list(itertools.product(range(3), repeat=3)))
    x = r.normal(size=(8, 27))
    ids = np.arange(8) * 5 + 2
    x[3] = 1.0
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "image_id long, values array<double>")
    got = {(g["center_id"], g["i"], g["j"]): g["value"] for g in searchlight.searchlight_distances(frame, spatial.grid(spark, 3), 1.5, metric).collect()}
    assert len(got) == 27 * 28
    for c in range(27):
        near = np.flatnonzero(((points - points[c]) ** 2).sum(axis=1) <= 2.25)
        for a, b in itertools.combinations(range(8), 2):
            p, q = x[a, near], x[b, near]
            want = np.linalg.norm(p - q) if metric == "euclidean" else 1.0 if p.std() == 0 or q.std() == 0 else 1 - np.corrcoef(p, q)[0, 1]
            assert abs(got[c, ids[a], ids[b]] - want) < 1e-8


def test_resampling_between_affines(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(2, 125))
    frame = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)] + [(2, None)], "image_id long, values array<double>")
    five, two = spatial.grid(spark, 5), spatial.grid(spark, 2)
    unit = np.diag([2.0, 2.0, 2.0, 1.0])

    def resampled(target, affine, how="linear"):
        got = {g["image_id"]: g["values"] for g in searchlight.resample(frame, five, unit, target, affine, how).collect()}
        assert got[2] is None
        return np.array([got[0], got[1]])

    np.testing.assert_allclose(resampled(five, unit), x)  # the same grid
    cube = x.reshape(2, 5, 5, 5)
    shifted = unit.copy()
    shifted[:3, 3] = [1.0, 0.0, 2.0]  # half a voxel along i, a whole one along k
    padded = np.pad(cube, ((0, 0), (0, 1), (0, 0), (0, 1)))
    np.testing.assert_allclose(resampled(five, shifted), ((padded[:, :5, :, 1:] + padded[:, 1:, :, 1:]) / 2).reshape(2, -1), atol=1e-12)
    wide = np.diag([4.0, 4.0, 4.0, 1.0])
    wide[:3, 3] = 1.0  # the middle of 2 x 2 x 2 voxels: their mean
    np.testing.assert_allclose(resampled(two, wide), cube[:, :4, :4, :4].reshape(2, 2, 2, 2, 2, 2, 2).mean(axis=(2, 4, 6)).reshape(2, -1), atol=1e-12)
    turned = np.array([[0, 2.0, 0, 0], [2.0, 0, 0, 0], [0, 0, 2.0, 0], [0, 0, 0, 1]])
    np.testing.assert_allclose(resampled(five, turned, "nearest"), cube.transpose(0, 2, 1, 3).reshape(2, -1))
    with pytest.raises(ValueError, match="linear or nearest"):
        resampled(five, unit, "cubic")


def test_no_table_of_voxels_is_sent_to_all_tasks(spark):
    """As Parquet such tables are small enough for Spark to send them, whole, through the driver."""
    from tessera.sources.scratch import Scratch

    r = np.random.default_rng(3)
    with Scratch(spark, "test") as scratch:
        rows = scratch.save(regions.placed(long_of(spark, r.normal(size=(3, 64))), spatial.grid(spark, 4), 0.1))
        labels = rows.select("image_id", spark_col("voxel_id").alias("node"), spark_col("voxel_id").alias("to"))
        for made in (regions.neighbours(rows, regions.ALL), regions._followed(labels, labels), regions._numbered(rows.withColumn("region", spark_col("voxel_id")), 1)):
            assert made.count() and "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [1 << 20, 3])
def test_images_of_any_number_meet_a_stored_grid_without_being_sent(spark, monkeypatch, tmp_path, limit):
    """A stored grid is larger on disk than the few voxels over a threshold, which Spark would then send through the driver."""
    from tessera.operators import sizes
    from tessera.sources.scratch import Scratch

    monkeypatch.setattr(sizes, "SENT_ROWS", limit)
    sent, save = [], Scratch.save

    def watched(self, df):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        sent.extend(x for x in plan.splitlines() if "BroadcastHashJoin" in x)
        return save(self, df)

    monkeypatch.setattr(Scratch, "save", watched)
    r = np.random.default_rng(5)
    points = np.array(list(itertools.product(range(4), repeat=3)))
    values = r.normal(size=(20, 64)) * (r.random((20, 64)) < 0.5)
    at = points @ [1600, 40, 1]  # the corner of the grid that the images fill
    back = {int(x): v for v, x in enumerate(at)}
    spatial.grid(spark, 40).write.parquet(f"{tmp_path}/grid")
    rows = [(n, int(at[v]), float(x)) for n, row in enumerate(values) for v, x in enumerate(row)]
    spark.createDataFrame(rows, "image_id long, voxel_id int, value double").write.parquet(f"{tmp_path}/long")
    got = regions.clusters(spark.read.parquet(f"{tmp_path}/long"), spark.read.parquet(f"{tmp_path}/grid"), 0.8, 2)
    assert {(x["image_id"], x["cluster"], back[x["voxel_id"]]) for x in got.collect()} == plain_clusters(values, points, 0.8, 2)
    # the grid alone, the right side, and only where its rows are few
    assert len(sent) == (limit > 3) and all("BuildRight" in x for x in sent)


@pytest.mark.parametrize("name", ["clusters", "cluster_table"])
def test_queries_of_clusters_send_nothing_but_the_grid(spark, monkeypatch, name):
    """Tables are all a few KB here: any join that leaves it to their size sends one whole through the driver."""
    import tessera.plans  # noqa: F401
    from tessera.plans import registry
    from tessera.sources.scratch import Scratch

    plans, save = [], Scratch.save

    def watched(self, df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return save(self, df)

    monkeypatch.setattr(Scratch, "save", watched)
    made = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    plans.append(made._jdf.queryExecution().sparkPlan().toString())
    assert made.count() and sum("SortMergeJoin" in x for x in plans) > 3
    sends = [x for x in plans if "Broadcast" in x]
    assert len(sends) == 1 and sends[0].count("BroadcastHashJoin") == 1 and "Range (0, 64" in sends[0]


def test_peaks_of_many_clusters_are_kept_apart_in_one_task(spark):
    """Clusters of all sizes against plain loops, with ties; a cluster may lie in several batches, and a task holds many clusters."""
    r = np.random.default_rng(8)
    voxels = spatial.grid(spark, 8)
    places = np.array(list(itertools.product(range(8), repeat=3)))
    rows, want = [], set()
    for image in range(6):
        of, values = r.integers(1, 40, 512), r.integers(-9, 10, 512) / 4.0
        of[r.permutation(512)[:200]] = 1  # a large one
        rows += [(image, int(c), v, float(x)) for v, (c, x) in enumerate(zip(of, values, strict=True))]
        for c in set(of.tolist()):
            kept = []
            for v in sorted(np.flatnonzero(of == c), key=lambda v: (-abs(values[v]), v)):
                if all(((places[v] - places[m]) ** 2).sum() >= 4 for m in kept):
                    kept.append(v)
            want |= {(image, c, int(v), float(values[v])) for v in kept}
    labelled = spark.createDataFrame(rows, "image_id long, cluster long, voxel_id int, value double").repartition(5)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        peaks = spatial.separate_peaks(labelled, voxels, 2.0)
        assert {tuple(x) for x in peaks.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    # a group a cluster cost some 2 ms a cluster, a job that grew with their number
    assert "FlatMapGroupsInPandas" not in peaks._jdf.queryExecution().toString()
