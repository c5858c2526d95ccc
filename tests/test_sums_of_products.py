"""Sums of products on the executors: correlations of columns, regions' sums, classifiers; means over neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import iterative, matrices, prediction, searchlight, spatial


def vectors(spark, rows, name="values"):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v]) for k, v in enumerate(rows)], f"image_id long, {name} array<double>").repartition(3)


@pytest.mark.parametrize("held, stack", [(1 << 22, 1 << 24), (1, 40)])
def test_column_correlations_equal_numpy(spark, monkeypatch, held, stack):
    monkeypatch.setattr(matrices, "COLUMNS", 3)
    monkeypatch.setattr(matrices, "HELD", held)
    monkeypatch.setattr(matrices, "STACK", stack)
    v = np.random.default_rng(1).normal(size=(50, 8)) + 1e4
    v[:, 5] = 2.0
    got = {(r["i"], r["j"]): r["r"] for r in matrices.column_correlations(vectors(spark, v)).collect()}
    want = np.corrcoef(np.delete(v, 5, axis=1).T)
    names = [k for k in range(8) if k != 5]
    assert set(got) == {(i, j) for i in range(8) for j in range(i + 1, 8)}
    for a, i in enumerate(names):
        for b, j in enumerate(names):
            if i < j:
                assert abs(got[i, j] - want[a, b]) < 1e-9
    assert all(r == 0 for (i, j), r in got.items() if 5 in (i, j))


def test_column_correlations_of_nothing_and_of_missing_values(spark):
    assert matrices.column_correlations(vectors(spark, [[1, 2]]).filter("image_id < 0")).count() == 0
    with pytest.raises(ValueError, match="null or non-finite"):
        matrices.column_correlations(vectors(spark, [[1, None], [2, 3]]))


def test_pairs_of_two_sets_meet_once_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(matrices, "BLOCK", 4)
    r = np.random.default_rng(2)
    a, b = r.normal(size=(11, 5)), r.normal(size=(9, 5))
    got = matrices.pair_images(vectors(spark, a), vectors(spark, b), False).select("image_id_i", "image_id_j", "xy").collect()
    assert len(got) == 99
    assert all(abs(q["xy"] - a[q["image_id_i"]] @ b[q["image_id_j"]]) < 1e-12 for q in got)
    plan = matrices.pair_images(vectors(spark, a), vectors(spark, b), False)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_region_sums_are_those_of_numpy(spark, monkeypatch):
    monkeypatch.setattr(prediction, "HELD", 20)
    r = np.random.default_rng(3)
    rows = [(k % 2, "a" if k % 3 else None, k % 4, k % 2, list(map(float, r.normal(size=3 + k % 2)))) for k in range(60)]
    bad = [(0, "a", 0, None, [1.0, 2.0, 3.0]), (0, "a", 0, 1, None), (0, "a", 0, 1, [1.0, None, 2.0])]
    f = spark.createDataFrame(rows + bad, "roi int, part string, fold int, y int, x array<double>").repartition(5)
    got = {(q["roi"], q["part"], q["fold"], q["class"]): q for q in prediction.region_sums(f, ["roi", "part"], "x", "y", "fold").collect()}
    want: dict = {}
    for roi, part, fold, y, x in rows:
        want.setdefault((roi, part, fold, float(y)), []).append(x)
    assert set(got) == set(want)
    for key, x in want.items():
        n, s, g = prediction._unpack(got[key])
        x = np.array(x)
        assert n == len(x)
        np.testing.assert_allclose(s, x.sum(axis=0), atol=1e-9)
        np.testing.assert_allclose(g, x.T @ x, atol=1e-9)


def test_scores_leave_out_what_has_no_prediction(spark):
    r = np.random.default_rng(4)
    rows = [(1, k % 4, k % 2, list(map(float, r.normal(size=2) + 5 * (k % 2)))) for k in range(40)]
    f = spark.createDataFrame([*rows, (1, 0, None, [1.0, 1.0]), (1, 0, 1, None), (1, 1, 1, [None, 1.0])], "roi int, fold int, y int, x array<double>")
    w = prediction.cross_validated_weights(prediction.region_sums(f, ["roi"], "x", "y", "fold"), ["roi"], "lda")
    got = {q["fold"]: (q["n"], q["score"]) for q in prediction.cross_validated_scores(f, w, ["roi"], "x", "y", "fold", True).collect()}
    assert got == {k: (10, 1.0) for k in range(4)}


def test_newton_says_when_it_has_not_settled_and_leaves_settled_regions(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.normal(size=(90, 2))
    y = (x[:, 0] + r.logistic(size=90) > 0).astype(int)
    rows = [(k % 3, int(b), list(map(float, a))) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    f = spark.createDataFrame([*rows, (0, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (1, 1, [None, 1.0])], "roi int, y int, x array<double>")
    with pytest.raises(RuntimeError, match="did not settle"):
        iterative.newton_classifier(f, "roi", "x", "y", rounds=1)
    got = iterative.newton_classifier(f, "roi", "x", "y")
    alone = iterative.newton_classifier(f.filter("roi = 2"), "roi", "x", "y")
    assert set(got) == {0, 1, 2} and set(alone) == {2}
    np.testing.assert_allclose(got[2], alone[2], atol=1e-9)
    one = np.column_stack([np.ones(30), x[2::3]])
    p = 1 / (1 + np.exp(-one @ got[2]))
    gradient = one.T @ (p - y[2::3]) + np.r_[0, got[2][1:]]
    assert np.abs(gradient).max() < 1e-6
    assert iterative.newton_classifier(f.filter("roi > 7"), "roi", "x", "y") == {}


def brute(points, v, radius, weight):
    """mean and count over neighbours, voxel by voxel."""
    out = []
    for p in points:
        total = share = n = 0
        for q, x in zip(points, v, strict=True):
            d2 = ((p - q) ** 2).sum()
            if d2 <= radius * radius + 1e-9 and x is not None and not np.isnan(x):
                total, share, n = total + weight(d2) * x, share + weight(d2), n + 1
        out.append((total / share if n else None, n))
    return out


def test_means_over_neighbours_in_a_mask_equal_brute_force(spark):
    r = np.random.default_rng(6)
    points = np.array([(i, j, k) for i in range(4) for j in range(3) for k in range(5) if r.random() < 0.7]) - 2
    voxels = spark.createDataFrame([(n, *map(int, p)) for n, p in enumerate(points)], "voxel_id int, i int, j int, k int")
    whole, holes = list(r.normal(size=len(points))), list(r.normal(size=len(points)))
    holes[3], holes[7] = None, float("nan")
    alone = [None] * len(points)
    alone[0] = 1.5
    f = vectors(spark, [whole, holes, alone, None]).withColumn("n", F.col("image_id") * 4)
    sigma = 2.0 / np.sqrt(8 * np.log(2))
    smoothed = {q["image_id"]: q["values"] for q in searchlight.smooth(f, voxels, 2.0, 2.0).collect()}
    means = {q["image_id"]: (q["values"], q["seen"]) for q in searchlight.searchlight_means(f, voxels, 1.5, counted="seen").collect()}
    assert smoothed[3] is None and means[3] == (None, None)
    for k, v in enumerate((whole, holes, alone)):
        for got, (want, _) in zip(smoothed[k], brute(points, v, 2.0, lambda d2: np.exp(-d2 / (2 * sigma**2))), strict=True):
            assert got is None and want is None or abs(got - want) < 1e-12
        for got, seen, (want, n) in zip(*means[k], brute(points, v, 1.5, lambda d2: 1.0), strict=True):
            assert seen == n and (got is None and want is None or abs(got - want) < 1e-12)


def test_means_over_neighbours_refuse_what_they_cannot_do(spark):
    voxels = spatial.grid(spark, 2)
    assert searchlight.smooth(vectors(spark, [[1] * 8]).filter("image_id < 0"), voxels, 2.0).count() == 0
    with pytest.raises(Exception, match="another length"):
        searchlight.smooth(vectors(spark, [[1] * 7]), voxels, 2.0).collect()
    with pytest.raises(ValueError, match="positive"):
        searchlight.smooth(vectors(spark, [[1] * 8]), voxels, 0.0)
