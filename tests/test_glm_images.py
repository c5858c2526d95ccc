"""Linear models of whole images against numpy: least squares, and whitening with each voxel's autocorrelation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import glm_images as gi
from tessera.operators.sums import sum_arrays_by

COLUMNS = ["one", "x", "z"]


def data(spark, lengths, voxels, seed=0, gap=None):
    r = np.random.default_rng(seed)
    cubes, designs = {}, {}
    for run, n in lengths.items():
        x = np.column_stack([np.ones(n), np.sin(np.arange(n) / 3), r.normal(size=n)])
        noise = r.normal(size=(n, voxels))
        for k in range(1, n):
            noise[k] += np.linspace(-0.5, 0.8, voxels) * noise[k - 1]
        cubes[run], designs[run] = x @ r.normal(size=(3, voxels)) + noise, x
    rows = [(run, 2 * t, [float(v) for v in y]) for run, c in cubes.items() for t, y in enumerate(c)]
    images = spark.createDataFrame(rows, "run int, t long, values array<double>").repartition(7)
    design = spark.createDataFrame([(run, 2 * t, *map(float, v)) for run, d in designs.items() for t, v in enumerate(d)], "run int, t long, one double, x double, z double")
    return cubes, designs, images, design


def cochrane_orcutt(x, y, bins=100):
    """One whitening with the binned lag-one autocorrelation of the least-squares residuals."""
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    rho = np.trunc((e[1:] @ e[:-1]) / (e @ e) * bins) / bins
    wx, wy = x.copy(), y.copy()
    wx[1:] -= rho * x[:-1]
    wy[1:] -= rho * y[:-1]
    b = np.linalg.lstsq(wx, wy, rcond=None)[0]
    df = len(x) - x.shape[1]
    se = np.sqrt(((wy - wx @ b) ** 2).sum() / df * np.diag(np.linalg.inv(wx.T @ wx)))
    return rho, b, se, 1 - ((y - x @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("block", [64, 7])
def test_autoregressive_noise(spark, monkeypatch, block):
    monkeypatch.setattr(gi, "BLOCK", block)
    cubes, designs, images, design = data(spark, {1: 150, 2: 64, 5: 30}, 9)
    got = gi.fit_images(images, design, COLUMNS, "ar1").toPandas()
    assert len(got) == 3 * 9 * 3
    for run, y in cubes.items():
        for v in range(9):
            own = got[(got["run"] == run) & (got["voxel_id"] == v)].set_index("term").loc[COLUMNS]
            rho, b, se, r2 = cochrane_orcutt(designs[run], y[:, v])
            np.testing.assert_allclose(own["rho"], rho)
            np.testing.assert_allclose(own["effect"], b, atol=1e-8)
            np.testing.assert_allclose(own["se"], se, rtol=1e-7)
            np.testing.assert_allclose(own["t"], b / se, rtol=1e-6, atol=1e-8)
            np.testing.assert_allclose(own["r2"], r2, atol=1e-9)
            assert (own["df"] == len(y) - 3).all()
    assert len(set(got["rho"])) > 5 and (got["p"] >= 0).all() and (got["p"] <= 1).all()
    together = gi.fixed_effects(gi.fit_images(images, design, COLUMNS, "ar1")).toPandas().set_index(["voxel_id", "term"])
    own = got[(got["voxel_id"] == 4) & (got["term"] == "x")]
    assert together.loc[(4, "x")]["effect"] == pytest.approx(own["effect"].mean())
    assert together.loc[(4, "x")]["se"] == pytest.approx(np.sqrt((own["se"] ** 2).sum()) / 3)


def test_contrasts_predictions_and_residuals(spark, monkeypatch):
    monkeypatch.setattr(gi, "BLOCK", 16)
    cubes, designs, images, design = data(spark, {0: 40, 1: 17}, 5, seed=2)
    fit = gi.fit_images(images, design, COLUMNS)
    got = gi.predict_images(images.withColumn("label", F.lit("l")), design, fit, COLUMNS).toPandas().sort_values(["run", "t"])
    assert len(got) == 57 and (got["label"] == "l").all()
    for run, y in cubes.items():
        b = np.linalg.lstsq(designs[run], y, rcond=None)[0]
        own = got[got["run"] == run]
        np.testing.assert_allclose(np.stack(own["predicted"].to_list()), designs[run] @ b, atol=1e-8)
        np.testing.assert_allclose(np.stack(own["residual"].to_list()), y - designs[run] @ b, atol=1e-8)
    c = gi.fit_images(images, design, COLUMNS, contrasts={"d": "x - 2*z"}).filter("run = 0").toPandas().sort_values("voxel_id")
    b = np.linalg.lstsq(designs[0], cubes[0], rcond=None)[0]
    np.testing.assert_allclose(c["effect"], b[1] - 2 * b[2], atol=1e-8)
    assert (c["rho"] == 0).all() and set(c["term"]) == {"d"}


def test_images_and_designs_that_do_not_match(spark):
    cubes, designs, images, design = data(spark, {0: 30, 1: 3}, 4, seed=3)
    got = gi.fit_images(images.filter("run = 1 OR t <> 20"), design.filter("t <> 10"), COLUMNS, "ar1").toPandas()
    keep = [k for k in range(30) if 2 * k not in (10, 20)]
    rho, b, se, _ = cochrane_orcutt(designs[0][keep], cubes[0][keep, 2])
    own = got[(got["run"] == 0) & (got["voxel_id"] == 2)].set_index("term").loc[COLUMNS]
    np.testing.assert_allclose(own["effect"], b, atol=1e-8)
    np.testing.assert_allclose(own["rho"], rho)
    assert got[got["run"] == 1][["se", "t"]].isna().all(axis=None)  # as many times as regressors
    assert gi.fit_images(images.limit(0), design, COLUMNS).collect() == []
    flat = gi.fit_images(images.withColumn("values", F.array(F.lit(2.0), F.lit(0.0))), design, COLUMNS, "ar1").filter("run = 0 AND term = 'one'").toPandas().sort_values("voxel_id")
    np.testing.assert_allclose(flat["effect"], [2, 0], atol=1e-9)
    with pytest.raises(ValueError, match="ols or ar1"):
        gi.fit_images(images, design, COLUMNS, "ar2")


def test_sums_by_key_over_many_tasks(spark):
    frame = spark.range(500).withColumn("k", (F.col("id") % 3).cast("int")).repartition(40)

    def made(batches):
        for b in batches:
            for k, g in b.groupby("k"):
                yield k, np.array([[float(g["id"].sum()), 1.0, 2.0], [float(len(g)), 0.0, 0.0]])

    got = {}
    for r in sum_arrays_by(frame, "int", made, cells=2).collect():
        got.setdefault(r["key"], {})[r["at"]] = r["flat"]
    for k in range(3):
        ids = [i for i in range(500) if i % 3 == k]
        assert sorted(got[k]) == [0, 2] and got[k][0][0] == sum(ids) and got[k][0][2] == len(ids)
