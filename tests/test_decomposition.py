"""Decompositions against numpy, and what may not leak from a held-out fold."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import decomposition as dc


def frame_of(spark, x, fold=None):
    rows = [(i, [float(v) for v in r], None if fold is None else int(fold[i])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "image_id long, values array<double>, fold int").repartition(5)


def numpy_components(x, n):
    c = x - x.mean(axis=0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    v = v[:n]
    return v * np.sign(v[np.arange(n), np.abs(v).argmax(axis=1)])[:, None], s[:n] ** 2 / (len(x) - 1)


def test_components_of_each_training_set(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(120, 4)) * [5, 4, 3, 2] @ r.normal(size=(4, 30)) + r.normal(size=(120, 30)) * 0.1 + 7
    fold = np.arange(120) % 3
    got = dc.components_by_fold(frame_of(spark, x, fold), 3, "fold")
    assert sorted(got) == [0, 1, 2]
    for f, m in got.items():
        parts, variance = numpy_components(x[fold != f], 3)
        np.testing.assert_allclose(m.forward, parts, atol=1e-6)
        np.testing.assert_allclose(m.variance, variance, rtol=1e-8)
        np.testing.assert_allclose(m.mean, x[fold != f].mean(axis=0))
    one = dc.components_by_fold(frame_of(spark, x), 40)[None]  # as many as elements at most
    assert one.forward.shape == (30, 30)
    scored = dc.transform(frame_of(spark, x), one)
    back = dc.inverse_transform(scored, one).orderBy("image_id").collect()
    np.testing.assert_allclose(np.array([b["values"] for b in back]), x, atol=1e-8)


def test_a_held_out_fold_never_reaches_its_model(spark):
    r = np.random.default_rng(2)
    x, fold = r.uniform(-1, 1, size=(240, 3)) @ r.normal(size=(3, 12)) + 0.01 * r.normal(size=(240, 12)), np.arange(240) % 3
    other = np.where((fold == 1)[:, None], 100 * r.normal(size=x.shape), x)
    for make in (dc.components_by_fold, dc.independent_components):
        a, b = (make(frame_of(spark, v, fold), 3, "fold") for v in (x, other))
        assert sorted(a) == sorted(b) == [0, 1, 2]
        np.testing.assert_allclose(a[1].forward, b[1].forward, atol=1e-6)
        assert np.abs(a[0].forward - b[0].forward).max() > 1e-3
    got = dc.reduced_ridge(frame_of(spark, x, fold).withColumn("y", F.col("values")[0]), "y", "fold", 4).toPandas()
    want = []
    for f in range(3):
        t, h = x[fold != f], x[fold == f]
        parts, _ = numpy_components(t, 4)
        s, z = (t - t.mean(0)) @ parts.T, (h - t.mean(0)) @ parts.T
        w = np.linalg.solve(s.T @ s + np.eye(4), s.T @ (t[:, 0] - t[:, 0].mean()))
        miss = h[:, 0] - t[:, 0].mean() - z @ w
        want.append(1 - (miss**2).sum() / ((h[:, 0] - h[:, 0].mean()) ** 2).sum())
    np.testing.assert_allclose(got.sort_values("fold")["r2"], want, atol=1e-6)
    assert len(dc.reduced_ridge(frame_of(spark, x, fold).withColumn("y", F.col("values")[0]), "y", "fold", 3, method="ica").collect()) == 3


def test_planted_sources_are_found(spark):
    r = np.random.default_rng(3)
    n = 2000
    sources = np.stack([r.uniform(-1, 1, n), r.laplace(size=n), np.sign(np.sin(np.arange(n) / 7.0)) + 0.05 * r.normal(size=n)], axis=1)
    x = sources @ r.normal(size=(3, 20)) + 0.01 * r.normal(size=(n, 20)) + 3
    model = dc.independent_components(frame_of(spark, x), 3)[None]
    got = np.array([s["scores"] for s in dc.transform(frame_of(spark, x), model).orderBy("image_id").collect()])
    assert model.settled
    r2 = np.abs(np.corrcoef(got.T, sources.T)[:3, 3:])
    assert r2.max(axis=0).min() > 0.95 and sorted(r2.argmax(axis=0)) == [0, 1, 2]
    np.testing.assert_allclose(got.std(axis=0, ddof=1), 1, atol=1e-6)
    np.testing.assert_allclose(got @ model.back + model.mean, x, atol=0.1)


def best_non_negative(x, parts):
    """The least error of x by non-negative sums of parts: every subset of them."""
    best = (x**2).sum()
    for size in range(1, len(parts) + 1):
        for chosen in itertools.combinations(range(len(parts)), size):
            w = np.linalg.lstsq(parts[list(chosen)].T, x, rcond=None)[0]
            if (w >= -1e-12).all():
                best = min(best, ((x - w @ parts[list(chosen)]) ** 2).sum())
    return best


def test_non_negative_factors(spark):
    r = np.random.default_rng(4)
    x = r.uniform(size=(60, 3)) @ np.maximum(r.normal(size=(3, 12)), 0) + 0.01 * r.uniform(size=(60, 12))
    x[5] = 0
    found = dc.non_negative_factors(frame_of(spark, x), 3, tolerance=1e-9, rounds=25)
    assert (np.diff(found.objective) <= 1e-9).all() and (found.parts >= 0).all()
    codes = np.array([c["codes"] for c in dc.encode(frame_of(spark, x), found).orderBy("image_id").collect()])
    assert (codes >= 0).all() and (codes[5] == 0).all()
    # every row's factor is the best there is
    np.testing.assert_allclose(((x - codes @ found.parts) ** 2).sum(axis=1), [best_non_negative(v, found.parts) for v in x], atol=1e-9)
    assert found.objective[-1] < 0.01 * (x**2).sum()
    # the same rounds in numpy
    parts = x.mean(axis=0) * np.random.default_rng(0).uniform(0.1, 2.0, (3, 12))
    for want in found.objective[:5]:
        w = dc.factor_codes(x, parts, 0.0, False)
        assert abs(((x - w @ parts) ** 2).sum() / 2 - want) < 1e-9
        parts = np.array([best for best in dc.non_negative_codes(w.T @ w, x.T @ w).T])
    with pytest.raises(ValueError, match="negative"):
        dc.non_negative_factors(frame_of(spark, x - 1), 2)
    with pytest.raises(ValueError, match="one vector"):
        dc.non_negative_factors(frame_of(spark, x).limit(0), 2)


def test_dictionary_codes_are_lasso_optima_and_the_objective_falls(spark):
    r = np.random.default_rng(5)
    atoms = r.normal(size=(4, 15))
    atoms /= np.linalg.norm(atoms, axis=1)[:, None]
    x = (r.normal(size=(150, 4)) * 5 * (r.uniform(size=(150, 4)) < 0.4)) @ atoms + 0.01 * r.normal(size=(150, 15))
    found = dc.dictionary(frame_of(spark, x), 4, penalty=0.2, rounds=40)
    assert (np.diff(found.objective) <= 1e-9 * found.objective[0]).all() and (np.linalg.norm(found.parts, axis=1) <= 1 + 1e-9).all()
    codes = np.array([c["codes"] for c in dc.encode(frame_of(spark, x), found).orderBy("image_id").collect()])
    slope = (codes @ found.parts - x) @ found.parts.T  # the conditions of a lasso optimum
    np.testing.assert_allclose(slope[codes != 0], -0.2 * np.sign(codes[codes != 0]), atol=1e-6)
    assert (np.abs(slope[codes == 0]) <= 0.2 + 1e-6).all() and (codes == 0).mean() > 0.2
    assert np.abs(found.parts @ atoms.T).max(axis=1).min() > 0.9  # the planted atoms


def test_factor_analysis_likelihood_rises_to_the_optimum(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 2)) @ r.normal(size=(2, 10)) * 2 + r.normal(size=(400, 10)) * np.linspace(0.3, 2, 10) + 1
    got = dc.factor_analysis(frame_of(spark, x), 2, rounds=80)
    assert (np.diff(got.likelihood) >= -1e-6).all() and len(got.likelihood) > 2
    # the likelihood from the whole covariance, and EM in numpy from another start
    cov = np.cov(x.T, bias=True)

    def likelihood(loadings, noise):
        model = loadings.T @ loadings + np.diag(noise)
        return -len(x) / 2 * (10 * np.log(2 * np.pi) + np.linalg.slogdet(model)[1] + np.trace(np.linalg.solve(model, cov)))

    loadings, noise = r.normal(size=(2, 10)), np.ones(10)
    for _ in range(3000):
        beta = np.linalg.solve(loadings.T @ loadings + np.diag(noise), loadings.T).T
        second = np.eye(2) - beta @ loadings.T + beta @ cov @ beta.T
        loadings = np.linalg.solve(second, beta @ cov)
        noise = np.diag(cov) - (loadings * (beta @ cov)).sum(axis=0)
    assert abs(likelihood(got.loadings, got.noise) - likelihood(loadings, noise)) < 0.01
    assert got.likelihood[-1] <= likelihood(got.loadings, got.noise) + 1e-6
    np.testing.assert_allclose(got.loadings.T @ got.loadings, loadings.T @ loadings, atol=0.05)
