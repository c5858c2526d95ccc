"""Bootstraps of pairs and of ridge models against plain loops."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import inference, resampling
from tessera.operators.inference import bootstrap_weights


def pairs_of(spark, cube):
    """cube: subjects x times x voxels, NaN where absent."""
    rows = [(int(s), int(t), int(v), float(cube[s, t, v])) for s, t, v in np.ndindex(cube.shape) if not np.isnan(cube[s, t, v])]
    return inference.isc_pairwise(spark.createDataFrame(rows, "subject int, t long, voxel_id long, value double").repartition(5))


def planted(subjects=9, times=60, voxels=40, seed=0):
    r = np.random.default_rng(seed)
    shared = r.normal(size=(1, times, voxels))
    return shared * np.linspace(0, 1.5, voxels) + r.normal(size=(subjects, times, voxels))


@pytest.mark.parametrize("piece", [1 << 22, 32 * 9 * 7])
def test_pairwise_correlations_by_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(inference, "PIECE", piece)
    cube = planted(subjects=6)
    cube[2, 40:] = np.nan
    cube[3, :, 5] = 1.0
    cube[4, :, 7] = np.nan
    cube[5, :30, 8], cube[1, 30:, 8] = np.nan, np.nan
    got = {(x["a"], x["b"], x["voxel_id"]): x["r"] for x in pairs_of(spark, cube).collect()}
    want = {}
    for a, b in itertools.combinations(range(6), 2):
        for v in range(cube.shape[2]):
            both = ~np.isnan(cube[a, :, v]) & ~np.isnan(cube[b, :, v])
            x, y = cube[a, both, v], cube[b, both, v]
            if both.any():
                want[a, b, v] = 0.0 if x.std() == 0 or y.std() == 0 else np.corrcoef(x, y)[0, 1]
    assert set(got) == set(want) and (1, 5, 8) not in got
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), atol=1e-9)


def plain_null(r, n, draws, how):
    """Resampled subjects by indexing, a subject's pairs with itself masked."""
    out = []
    for picked in draws:
        inside = [r[min(a, b), max(a, b)] for a, b in itertools.combinations(picked, 2) if a != b]
        if not inside:
            out.append(np.nan)
        else:
            out.append(np.median(inside) if how == "median" else np.tanh(np.mean(np.arctanh(np.clip(inside, -0.9999, 0.9999)))))
    return np.array(out)


@pytest.mark.parametrize("how", ["median", "mean"])
def test_pair_bootstrap(spark, how):
    cube = planted(subjects=7, voxels=6)
    rs = pairs_of(spark, cube)
    got = {x["voxel_id"]: x for x in resampling.isc_pairwise_bootstrap(rs, 200, how).collect()}
    draws = resampling.random_draws(11)(7, np.arange(1, 201))
    for v in range(6):
        r = np.corrcoef(cube[:, :, v])
        own = r[np.triu_indices(7, 1)]
        observed = np.median(own) if how == "median" else np.tanh(np.arctanh(own).mean())
        null = plain_null(r, 7, draws, how)
        assert got[v]["isc"] == pytest.approx(observed)
        assert got[v]["p"] == pytest.approx(((np.abs(null - observed) >= abs(observed) - 1e-12).sum() + 1) / 201)
        np.testing.assert_allclose([got[v]["lo"], got[v]["hi"]], np.percentile(null, [2.5, 97.5]), atol=1e-9)
    assert got[5]["p"] < 0.05 < got[0]["p"]  # shared signal and none
    few = resampling.isc_pairwise_bootstrap(rs.filter("a = 0 AND b = 1 OR voxel_id = 3"), 50, how, subjects=range(7)).collect()
    assert len(few) == 6 and all(x["lo"] <= x["isc"] + 1e-9 for x in few)


def test_intervals_cover_and_groups_differ(spark):
    r = np.random.default_rng(5)
    shared = r.normal(size=(1, 80, 4))
    cube = np.concatenate([shared * 2 + r.normal(size=(6, 80, 4)), r.normal(size=(6, 80, 4))])
    cube[6:, :, 3] += shared[:, :, 3] * 2
    rs = pairs_of(spark, cube)
    got = {x["voxel_id"]: x for x in resampling.isc_group_bootstrap(rs, {s: "ab"[s > 5] for s in range(12)}, 300).collect()}
    for v in range(4):
        m = np.corrcoef(cube[:, :, v])
        want = np.median(m[:6, :6][np.triu_indices(6, 1)]) - np.median(m[6:, 6:][np.triu_indices(6, 1)])
        assert got[v]["difference"] == pytest.approx(want) and got[v]["lo"] <= got[v]["difference"] + 0.2
    assert got[0]["p"] < 0.05 < got[3]["p"] and got[0]["lo"] > 0.3
    with pytest.raises(ValueError, match="two groups"):
        resampling.isc_group_bootstrap(rs, {0: 1}, 10)
    # the planted correlation of the population, 4 / (4 + 1), lies within the interval
    one = {x["voxel_id"]: x for x in resampling.isc_pairwise_bootstrap(rs.filter("a < 6 AND b < 6"), 300).collect()}
    assert sum(one[v]["lo"] - 0.05 <= 0.8 <= one[v]["hi"] + 0.05 for v in range(4)) >= 3


def test_weighted_medians():
    r = np.random.default_rng(1)
    values, weights = r.normal(size=9), r.integers(0, 4, (50, 9)).astype(float)
    weights[3] = 0
    got = resampling.weighted_medians(values, weights)
    want = [np.median(np.repeat(values, w.astype(int))) if w.any() else np.nan for w in weights]
    np.testing.assert_allclose(got, want)


@pytest.mark.parametrize("block", [16 << 20, 8 * 51 * 3 * 7])
def test_ridge_bootstraps(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK_BYTES", block)
    r = np.random.default_rng(2)
    x, ids = r.normal(size=(70, 3)), np.arange(70) * 3
    y = x @ r.normal(size=(3, 11)) + r.normal(size=(70, 11))
    frame = spark.createDataFrame([(int(i), a.tolist(), b.tolist()) for i, a, b in zip(ids, x, y, strict=True)], "image_id long, x array<double>, values array<double>").repartition(6)
    got = resampling.ridge_weight_bootstrap(frame, "x", 3, 50, alpha=2.0).toPandas().sort_values(["feature", "voxel_id"])
    w = bootstrap_weights()(ids, np.arange(51))
    fits = np.stack([np.linalg.solve(x.T @ (v[:, None] * x) + 2 * np.eye(3), x.T @ (v[:, None] * y)) for v in w])
    assert len(got) == 33
    for name, want in (("weight", fits[0]), ("mean", fits[1:].mean(0)), ("std", fits[1:].std(0, ddof=1)), ("lo", np.percentile(fits[1:], 2.5, axis=0)), ("hi", np.percentile(fits[1:], 97.5, axis=0))):
        np.testing.assert_allclose(got[name], want.reshape(-1), atol=1e-8, err_msg=name)
    np.testing.assert_allclose(got["z"], (fits[1:].mean(0) / fits[1:].std(0, ddof=1)).reshape(-1), rtol=1e-6)
    asked = r.normal(size=(5, 3))
    tests = spark.createDataFrame([(k, a.tolist()) for k, a in enumerate(asked)], "image_id long, x array<double>")
    got = resampling.ridge_prediction_bootstrap(frame, tests, "x", 3, 50, alpha=2.0, rows=2).toPandas().sort_values(["image_id", "voxel_id"])
    made = np.einsum("mk,rkv->rmv", asked, fits)
    np.testing.assert_allclose(got["predicted"], made[0].reshape(-1), atol=1e-8)
    np.testing.assert_allclose(got["hi"], np.percentile(made[1:], 97.5, axis=0).reshape(-1), atol=1e-8)
    assert resampling.ridge_weight_bootstrap(frame.limit(0), "x", 3, 5).collect() == []
    with pytest.raises(ValueError, match="alpha"):
        resampling.ridge_weight_bootstrap(frame, "x", 3, 5, alpha=0)


def test_predictions_of_one_block_are_made_by_many_tasks(spark):
    frame = spark.range(400).select(
        F.col("id").alias("image_id"), F.array(F.lit(1.0), F.col("id") % 5 / 5.0).alias("x"), F.array(F.col("id") % 7 / 7.0, F.col("id") % 3 / 3.0).alias("values")
    )
    got = resampling.ridge_prediction_bootstrap(frame, frame.select("image_id", "x"), "x", 2, 5).withColumn("task", F.spark_partition_id())
    seen = got.groupBy("task").count().toPandas()["count"]
    assert seen.sum() == 800 and len(seen) > 1  # one block of voxels was one task, whatever the rows asked for
