"""Joins give the same, whether a side is small enough to be sent to all tasks or not."""

import numpy as np
import pytest

from tessera.operators import inference, matrices, ranks, sizes, spatial


@pytest.fixture(params=[1 << 20, 3])
def limit(request, monkeypatch):
    monkeypatch.setattr(sizes, "SENT_ROWS", request.param)
    return request.param


def test_only_small_sides_are_sent(spark, limit):
    assert ("broadcast" in sizes.sent(spark.range(4))._jdf.queryExecution().logical().toString().lower()) == (limit > 3)
    assert "broadcast" in sizes.sent(spark.range(3))._jdf.queryExecution().logical().toString().lower()


def test_nodes_and_groups_move_alike(spark, limit):
    r = np.random.default_rng(1)
    m, n = r.normal(size=(6, 6)), r.normal(size=(6, 6))
    square = lambda x: spark.createDataFrame([(0, i, j, float(x[i, j])) for i in range(6) for j in range(6)], "matrix_id int, i int, j int, value double")
    to = r.permutation(6)
    moved = {(q["i"], q["j"]): q["value"] for q in matrices.permute_nodes(square(m), spark.createDataFrame([(k, int(t)) for k, t in enumerate(to)], "i int, to int")).collect()}
    assert moved == {(int(to[i]), int(to[j])): m[i, j] for i in range(6) for j in range(6)}
    orders = [np.arange(6), *(r.permutation(6) for _ in range(9))]
    moves = spark.createDataFrame([(k, i, int(t)) for k, order in enumerate(orders) for i, t in enumerate(order)], "replicate long, i int, to int")
    got = inference.matrix_permutation(square(m).drop("matrix_id"), square(n).drop("matrix_id"), moves).first()
    upper, drawn = np.triu_indices(6, 1), []
    for order in orders:
        x = np.empty((6, 6))
        x[np.ix_(order, order)] = m
        drawn.append(np.corrcoef(x[upper], n[upper])[0, 1])
    assert got["stat"] == pytest.approx(drawn[0]) and got["p"] == pytest.approx((1 + sum(abs(d) >= abs(drawn[0]) - 1e-12 for d in drawn[1:])) / 10)
    folds = ranks.group_folds(spark.createDataFrame([(g,) for g in "ebdacab"], "g string"), "g").collect()
    assert sorted((q["g"], q["fold"]) for q in folds) == sorted((g, "abcde".index(g)) for g in "ebdacab")


def test_spheres_hold_their_voxels(spark, limit):
    values = spark.createDataFrame([(1, k, float(k)) for k in range(8)], "image_id long, voxel_id int, value double")
    got = {q["center_id"]: q["x"] for q in spatial.sphere_features(values, spatial.grid(spark, 2), 1.0).collect()}
    assert got == {c: sorted(float(v) for v in {c, c ^ 1, c ^ 2, c ^ 4}) for c in range(8)}
