"""Procrustes similarity, matched states and alignment of overlapping spheres, against numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import alignment, spatial


def test_procrustes_similarity_and_its_shuffles(spark):
    r = np.random.default_rng(1)
    a = r.normal(size=(25, 3))
    b = np.c_[a @ np.linalg.qr(r.normal(size=(3, 3)))[0] * 4 + 2, r.normal(size=25)] + 0.3 * r.normal(size=(25, 4))
    frame = spark.createDataFrame([(k * 7, x.tolist(), y.tolist()) for k, (x, y) in enumerate(zip(a, b, strict=True))], "k long, a array<double>, b array<double>").repartition(4)
    order = (F.col("k") * 7919 + F.col("replicate") * (F.col("k") % 31 + 1) * 104729) % 1000003
    got = alignment.procrustes_distance(frame, "a", "b", "k", 40, order).first()
    keys = np.arange(25) * 7
    null = []
    for n in range(1, 41):
        mixed = (keys * 7919 + n * (keys % 31 + 1) * 104729) % 1000003
        null.append(1 - alignment.procrustes(b, a[np.lexsort((keys, mixed))])[2])
    stat = 1 - alignment.procrustes(b, a)[2]
    assert got["stat"] == pytest.approx(stat) and got["p"] == pytest.approx((sum(v >= stat - 1e-12 for v in null) + 1) / 41)
    assert got["p"] < 0.05
    with pytest.raises(ValueError, match="without variance"):
        alignment.procrustes_distance(frame.withColumn("a", F.array(F.lit(1.0))), "a", "b", "k", 5)


@pytest.mark.parametrize("metric", ["correlation", "euclidean"])
def test_states_are_matched_at_least_cost(spark, metric):
    r = np.random.default_rng(2)
    reference = r.normal(size=(4, 12))
    rows, data = [], {}
    for s, n in ((0, 4), (1, 3), (2, 6)):
        data[s] = reference[r.permutation(4)][:n] + r.normal(size=(min(n, 4), 12)) if n <= 4 else r.normal(size=(n, 12))
        rows += [(s, k, v.tolist()) for k, v in enumerate(data[s])]
    got = {}
    for x in alignment.align_states(spark.createDataFrame(rows, "subject int, state int, values array<double>"), reference, metric).collect():
        got.setdefault(x["subject"], {})[x["state"]] = (x["matched"], x["cost"])
    for s, x in data.items():
        cost = np.array([[1 - np.corrcoef(u, v)[0, 1] if metric == "correlation" else np.linalg.norm(u - v) for v in reference] for u in x])
        small, large = sorted(cost.shape)
        best = min(sum((cost if len(cost) == small else cost.T)[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(large), small))
        matched = [(k, m, c) for k, (m, c) in got[s].items() if m is not None]
        assert len(matched) == small and len({m for _, m, _ in matched}) == small
        assert sum(c for _, _, c in matched) == pytest.approx(best) and all(cost[k, m] == pytest.approx(c) for k, m, c in matched)


def plain_local(cubes, points, radius, method, features, rounds, seed=0):
    """cubes: subject -> voxels x times; one group a sphere."""
    out = {}
    for c in range(len(points)):
        near = np.flatnonzero(((points - points[c]) ** 2).sum(axis=1) <= radius**2 + 1e-9)
        data = {}
        for s, x in cubes.items():
            x = x[near] - x[near].mean(axis=1, keepdims=True)
            data[s] = x / np.linalg.norm(x)
        if method == "srm":
            k = min(features, *next(iter(data.values())).shape)
            template = np.linalg.qr(np.random.default_rng([seed, c]).standard_normal((next(iter(data.values())).shape[1], k)))[0].T
            template = np.mean([alignment.rotation_onto(x, template).T @ x for x in data.values()], axis=0)
        else:
            template = np.mean(list(data.values()), axis=0)
        for _ in range(rounds - 1):
            template = np.mean([alignment.rotation_onto(x, template).T @ x for x in data.values()], axis=0)
        own = int(np.flatnonzero(near == c)[0])
        for s, x in data.items():
            w = alignment.rotation_onto(x, template)
            out[s, c] = (w.T @ x)[own] if method == "hyperalignment" else w[own] @ template
    return out


@pytest.mark.parametrize("method", ["hyperalignment", "srm"])
def test_local_alignment_equals_one_group_a_sphere(spark, method):
    r = np.random.default_rng(3)
    points = np.array(list(itertools.product(range(3), repeat=3)))
    shared = r.normal(size=(27, 20))
    cubes = {s: shared + 0.5 * r.normal(size=(27, 20)) for s in range(4)}
    rows = [(s, t, x[:, t].tolist()) for s, x in cubes.items() for t in range(20)]
    images = spark.createDataFrame(rows, "subject int, t long, values array<double>").repartition(6)
    got = {}
    for x in alignment.align_local(images, spatial.grid(spark, 3), 1.0, method, 3, rounds=3).collect():
        got.setdefault((x["subject"], x["voxel_id"]), {})[x["t"]] = x["value"]
    want = plain_local(cubes, points, 1.0, method, 3, 3)
    assert set(got) == set(want)
    for key, series in want.items():
        np.testing.assert_allclose([got[key][t] for t in range(20)], series, atol=1e-7)
    with pytest.raises(ValueError, match="equal numbers"):
        alignment.align_local(images.filter("subject > 0 OR t < 10"), spatial.grid(spark, 3), 1.0, method)


def test_centring_takes_time_in_proportion_to_the_samples(spark):
    import time

    from pyspark.sql import functions as F

    x = np.random.default_rng(4).normal(size=(3, 5)) + 2
    got = alignment.centred(spark.createDataFrame([(1, x.tolist())], "subject int, matrix array<array<double>>")).first()["matrix"]
    np.testing.assert_allclose(got, x - x.mean(axis=1, keepdims=True), atol=1e-12)
    one = F.transform(F.sequence(F.lit(1), F.lit(20000)), lambda k: k.cast("double"))
    frame = spark.range(1).select(F.col("id").alias("subject"), F.array(one, one).alias("matrix")).localCheckpoint()
    begin = time.time()
    made = alignment.centred(frame).select(F.get(F.get("matrix", F.lit(1)), F.lit(0)).alias("x")).first()["x"]
    assert made == -9999.5 and time.time() - begin < 10  # a mean for each sample: 800 million steps


@pytest.mark.parametrize("method", ["hyperalignment", "srm"])
def test_local_alignment_takes_times_in_stretches(spark, method, monkeypatch):
    """The same numbers whatever the length of a stretch; times need not be numbered from 0."""
    monkeypatch.setattr(alignment, "STRETCH", 16)
    r = np.random.default_rng(6)
    points = np.array(list(itertools.product(range(2), repeat=3)))
    shared = r.normal(size=(8, 37))
    cubes = {s: shared + 0.5 * r.normal(size=(8, 37)) + s for s in range(3)}
    rows = [(s, t * 5 + 9, x[:, t].tolist()) for s, x in cubes.items() for t in range(37)]
    images = spark.createDataFrame(rows, "subject int, t long, values array<double>").repartition(3)
    got = {}
    for x in alignment.align_local(images, spatial.grid(spark, 2), 1.0, method, 3, rounds=2).collect():
        got.setdefault((x["subject"], x["voxel_id"]), {})[x["t"]] = x["value"]
    want = plain_local(cubes, points, 1.0, method, 3, 2)
    assert set(got) == set(want)
    for key, series in want.items():
        np.testing.assert_allclose([got[key][t] for t in range(37)], series, atol=1e-7)
    placed = images.withColumn("t", (F.col("t") - 9) / 5)
    assert alignment.local_rows(placed.withColumn("t", F.col("t").cast("long")), points, 1.0).agg(F.max("times")).first()[0] == 16
