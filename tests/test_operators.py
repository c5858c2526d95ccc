"""Operators against numpy, and their results at the edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import distributions as dist
from tessera.operators import alignment, images, inference, matrices, models, prediction, regions, series, spatial
from tessera.sources import files
from tessera.streaming.moments import running_moments


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def close(a, b, tol=1e-9):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), atol=tol, rtol=1e-7)


def test_distributions_at_known_points():
    close(dist.t_sf2([2.228138852, 0.0, -12.7062047], [10, 5, 1]), [0.05, 1.0, 0.05], 1e-8)
    close(dist.f_sf([4.964602744, 0.0], [1, 3], [10, 7]), [0.05, 1.0], 1e-8)
    close(dist.norm_isf([0.025, 0.5, 1e-12, 0.975]), [1.959963985, 0.0, 7.034483825, -1.959963985], 1e-6)
    assert math.isclose(dist.binom_sf(8, 10, 0.5), 56 / 1024, rel_tol=1e-9)


def test_threshold_takes_nan_to_zero(spark):
    f = frame(spark, [(1, [1.0, -2.0, float("nan"), 0.5])], "image_id long, values array<double>")
    assert images.threshold(f, upper=0.6).first()["values"] == [1.0, 0.0, 0.0, 0.0]
    assert images.threshold(f, lower=-1.0, upper=0.6, binarize=True).first()["values"] == [1.0, 1.0, 0.0, 0.0]


def test_constant_columns_do_not_divide_by_zero(spark):
    f = frame(spark, [(k, [1.0, float(k)]) for k in range(4)], "image_id long, values array<double>")
    assert {r["values"][0] for r in images.standardize_voxels(f).collect()} == {0.0}
    s = frame(spark, [(1, k, 5.0) for k in range(4)], "subject long, row_id long, value double")
    assert {r["value"] for r in series.zscore(s, ["value"], ["subject"]).collect()} == {None}
    assert {r["value"] for r in series.detrend(s, ["subject"]).collect()} == {0.0}


def test_one_row_series(spark):
    s = frame(spark, [(1, 0, 5.0)], "subject long, row_id long, value double")
    assert series.upsample(s, ["subject"], 4).count() == 0
    assert series.find_spikes(s, ["subject"]).first()["diff_spike"] is False
    assert series.add_poly(s, ["subject"], 2).first()["poly_0"] == 1.0


def test_parse_contrast():
    close(models.parse_contrast("a - b", ["a", "b"]), [1, -1])
    close(models.parse_contrast("-2*a + b + b", ["a", "b"]), [-2, 2])
    with pytest.raises(ValueError):
        models.parse_contrast("a - c", ["a", "b"])


def test_linear_fit_matches_numpy(spark):
    r = np.random.default_rng(1)
    x = np.column_stack([np.ones(60), r.normal(size=(60, 2))])
    y = x @ [1.0, 2.0, -1.0] + r.normal(size=60) * 0.1
    f = frame(spark, [(1, *map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "g int, one double, a double, b double, y double")
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    res = y - x @ beta
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (res @ res) / 57)
    got = {q["term"]: q for q in models.fit_linear(f, ["one", "a", "b"], "y", ["g"]).collect()}
    close([got[k]["effect"] for k in ("one", "a", "b")], beta, 1e-8)
    close([got[k]["se"] for k in ("one", "a", "b")], se, 1e-8)
    c = models.fit_linear(f, ["one", "a", "b"], "y", ["g"], contrasts={"d": "a - b"}).first()
    close(c["effect"], beta[1] - beta[2], 1e-8)
    ridge = {q["term"]: q["effect"] for q in models.fit_linear(f, ["one", "a", "b"], "y", ["g"], alpha=3.0).collect()}
    close([ridge[k] for k in ("one", "a", "b")], np.linalg.solve(x.T @ x + 3 * np.eye(3), x.T @ y), 1e-8)


def test_ridge_cv_matches_numpy(spark):
    r = np.random.default_rng(2)
    x, fold = r.normal(size=(50, 3)), np.arange(50) % 5
    y = x @ [1.0, 0.0, 2.0] + r.normal(size=50)
    f = frame(spark, [(int(k), *map(float, a), float(b)) for k, a, b in zip(fold, x, y, strict=True)], "fold int, a double, b double, c double, y double")
    got = {(q["fold"], q["alpha"]): q["r2"] for q in models.ridge_cv(f, ["a", "b", "c"], "y", "fold", [0.5, 5.0]).collect()}
    for (k, alpha), r2 in got.items():
        t = fold != k
        beta = np.linalg.solve(x[t].T @ x[t] + alpha * np.eye(3), x[t].T @ y[t])
        e = y[~t] - x[~t] @ beta
        close(r2, 1 - e @ e / ((y[~t] - y[~t].mean()) ** 2).sum(), 1e-8)
    assert len(got) == 10


def test_bootstrap_is_near_the_standard_error(spark):
    r = np.random.default_rng(3)
    v = r.normal(1.0, 2.0, size=(200, 2))
    f = frame(spark, [(k, list(map(float, x))) for k, x in enumerate(v)], "image_id long, values array<double>")
    for q in inference.bootstrap(f, 800).collect():
        assert abs(q["std"] / (v[:, q["voxel_id"]].std(ddof=1) / 200**0.5) - 1) < 0.15
    a, b = (sorted(map(tuple, inference.one_sample_permutation(f.repartition(n), 99).collect())) for n in (1, 5))
    close(a, b)


def test_social_relations_recovers_pure_actor_effects(spark):
    rows = [(1, i, j, float(i)) for i in range(6) for j in range(6) if i != j]
    got = matrices.social_relations(frame(spark, rows, "matrix_id long, i long, j long, value double")).first()
    close([got["actor"], got["partner"], got["relationship"], got["dyad"]], [np.var(range(6), ddof=1), 0, 0, 0], 1e-9)


def test_procrustes_finds_a_rotation():
    r = np.random.default_rng(4)
    a = r.normal(size=(20, 3))
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    _, _, disparity, rotation, scale = alignment.procrustes(a, 2.5 * a @ q + 1)
    close([disparity, scale], [0, 1], 1e-9)
    close(rotation, q.T, 1e-9)
    assert alignment.assign(np.array([[4.0, 1, 3], [2, 0, 5], [3, 2, 2]])) == [1, 0, 2]


@pytest.mark.parametrize("fit", [alignment.det_srm, alignment.srm])
def test_shared_response_lines_subjects_up(spark, fit):
    r = np.random.default_rng(5)
    shared = r.normal(size=(3, 40))
    rows = [(s, [list(map(float, v)) for v in np.linalg.qr(r.normal(size=(10, 3)))[0] @ shared + 0.01 * r.normal(size=(10, 40))]) for s in range(4)]
    m = alignment.centred(frame(spark, rows, "subject long, matrix array<array<double>>"))
    maps, _ = fit(m, 3)
    got = [np.array(q["shared"]) for q in alignment.transform(m, maps).collect()]
    for x in got[1:]:
        assert np.corrcoef(x.ravel(), got[0].ravel())[0, 1] > 0.99


def test_prediction_separates_what_is_separable(spark):
    r = np.random.default_rng(6)
    rows = [(1, k % 4, k % 2, list(map(float, r.normal(size=3) + 4 * (k % 2)))) for k in range(80)]
    f = frame(spark, rows, "roi int, fold int, y int, x array<double>")
    for model in ("lda", "ridge_classifier"):
        w = prediction.cross_validated_weights(prediction.region_sums(f, ["roi"], "x", "y", "fold"), ["roi"], model)
        assert min(q["score"] for q in prediction.cross_validated_scores(f, w, ["roi"], "x", "y", "fold", True).collect()) > 0.9


def test_clusters_are_26_connected_and_of_one_sign(spark):
    v = spatial.grid(spark, 3)
    values = {0: 2.0, 13: 2.0, 26: 2.0, 2: -2.0, 18: 2.0}
    long = frame(spark, [(1, k, values.get(k, 0.0)) for k in range(27)], "image_id long, voxel_id int, value double")
    got = {(q["cluster"], q["voxel_id"]) for q in regions.clusters(long, v, 1.0).collect()}
    assert got == {(1, 0), (1, 13), (1, 18), (1, 26), (2, 2)}
    assert [q["n_voxels"] for q in spatial.cluster_table(regions.clusters(long, v, 1.0, 2)).collect()] == [4]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("a\tb\n1\tn/a\n\t2.5\n")
    d = files.read_design(spark, str(tmp_path / "d.tsv"))
    assert [tuple(r) for r in d.orderBy("row_id").collect()] == [(0, 1.0, None), (1, None, 2.5)]
    files.write_design(d.fillna(0.0), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    files.write_bundle(str(tmp_path / "b"), {"tr": 2.0}, design=d)
    attributes, frames = files.read_bundle(spark, str(tmp_path / "b"))
    assert attributes == {"tr": 2.0} and frames["design"].count() == 2
    (tmp_path / "sub-01_task-rest_run-2_bold.json").write_text("{}")
    m = files.manifest(spark, str(tmp_path), "*.json").first()
    assert (m["subject"], m["task"], m["run"], m["session"]) == ("01", "rest", "2", None)
    (tmp_path / "e.csv").write_text("onset,duration,trial_type\n0,2,x\n3,1,y\n")
    events = files.read_events(spark, str(tmp_path / "e.csv"))
    box = series.boxcar(events, 5, 1.0, ["x", "y"]).orderBy("row_id").collect()
    assert [(r["x"], r["y"]) for r in box] == [(1, 0), (1, 0), (0, 0), (0, 1), (0, 0)]


def test_squares_and_kinds(spark):
    adj = frame(spark, [(1, 0, 1, 2.0), (1, 0, 2, 3.0), (1, 1, 2, 4.0)], "matrix_id long, i int, j int, value double")
    square = matrices.full_square(adj)
    wide = files.to_square(square, range(3))
    assert sorted(map(tuple, files.from_square(wide, range(3)).collect())) == sorted(map(tuple, adj.collect()))
    assert files.matrix_kind(square).first()["kind"] == "distance"
    assert files.matrix_kind(square.filter("i <= j")).first()["kind"] == "directed"


def test_running_moments_of_a_stream(spark, tmp_path):
    rows = [(k % 2, float(k)) for k in range(10)]
    frame(spark, rows, "g int, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g int, value double").parquet(str(tmp_path / "in"))
    q = running_moments(stream, "g").writeStream.outputMode("complete").format("memory").queryName("moments").start()
    q.processAllAvailable()
    q.stop()
    got = {r["g"]: r for r in spark.table("moments").collect()}
    close([got[1]["n"], got[1]["mean"], got[1]["var"]], [5, 5.0, np.var([1, 3, 5, 7, 9], ddof=1)])


def test_empty_tables_give_empty_results(spark):
    f = frame(spark, [], "image_id long, values array<double>")
    assert images.standardize_voxels(f).count() == 0
    assert inference.one_sample_permutation(f, 9).count() == 0
    assert matrices.edge_ttest(frame(spark, [], "matrix_id long, i long, j long, value double")).agg(F.count("i")).first()[0] == 0


def test_pchip_keeps_points_and_does_not_overshoot():
    from tessera.operators import signals

    y = np.array([0.0, 1.0, 1.0, 4.0, 0.0])
    close(signals.pchip(y, np.arange(5.0)), y)
    fine = signals.pchip(y, np.linspace(1, 2, 50))
    close(fine, np.ones(50))
    close(signals.pchip(np.array([1.0, 3.0]), np.array([0.5])), [2.0])


def test_filters_pass_and_stop():
    from tessera.operators import signals

    t = np.arange(400)
    slow, fast = np.sin(2 * np.pi * 0.01 * t), np.sin(2 * np.pi * 0.3 * t)
    kept = signals.bandpassed(slow + fast, 1.0, None, 0.1)
    assert np.abs(kept - slow)[20:-20].max() < 0.05
    y = np.random.default_rng(1).normal(size=101)
    z = signals.phase_randomized(y, 3)
    close(np.abs(np.fft.rfft(z)), np.abs(np.fft.rfft(y)), 1e-8)
    close(np.diff(np.unwrap(signals.hilbert_angle(slow)))[50:-50], np.full(299, 2 * np.pi * 0.01), 1e-3)


def test_newton_classifiers_reach_their_optimum(spark):
    from tessera.operators import iterative

    r = np.random.default_rng(7)
    x = r.normal(size=(120, 2))
    y = (x @ [1.5, -1.0] + 0.3 + r.logistic(size=120) > 0).astype(int)
    f = frame(spark, [(1, int(b), list(map(float, a))) for a, b in zip(x, y, strict=True)], "roi int, y int, x array<double>")
    for loss in ("logistic", "squared_hinge"):
        w = iterative.newton_classifier(f, "roi", "x", "y", loss)[1]

        def cost(v, loss=loss):
            m = (2 * y - 1) * (v[0] + x @ v[1:])
            return v[1:] @ v[1:] / 2 + (np.log1p(np.exp(-m)).sum() if loss == "logistic" else (np.maximum(1 - m, 0) ** 2).sum())

        assert all(cost(w) <= cost(w + d) + 1e-9 for d in 1e-3 * r.normal(size=(20, 3)))


def test_principal_components_match_numpy(spark):
    from tessera.operators import iterative

    v = np.random.default_rng(8).normal(size=(60, 4)) * [3, 2, 1, 0.5] + 5
    f = frame(spark, [(k, list(map(float, a))) for k, a in enumerate(v)], "image_id long, values array<double>")
    parts, variance = iterative.principal_components(images.gram(f), images.reduce_images(f, "mean"), 2, 60)
    want = np.sort(np.linalg.eigvalsh(np.cov(v.T)))[::-1][:2]
    close(variance, want, 1e-8)
    close(parts @ np.cov(v.T) @ parts.T, np.diag(want), 1e-8)


@pytest.mark.parametrize("fan", [8, 2])
def test_leading_components_match_numpy(spark, fan, monkeypatch):
    from tessera.operators import iterative, sums

    monkeypatch.setattr(sums, "FAN", fan)  # 2: partial sums meet in further tasks before the driver
    monkeypatch.setattr(sums, "CELLS", 7)
    v = np.random.default_rng(8).normal(size=(90, 30)) + 5
    f = frame(spark, [(k, list(map(float, a))) for k, a in enumerate(v)], "image_id long, values array<double>")
    parts, variance = iterative.leading_components(f, 3)
    close(variance, np.sort(np.linalg.eigvalsh(np.cov(v.T)))[::-1][:3], 1e-8)
    close(parts @ parts.T, np.eye(3), 1e-8)
    close(np.cov(v.T) @ parts.T, parts.T * variance, 1e-6)
    assert len(iterative.leading_components(f, 99)[1]) == 30
    same = frame(spark, [(k, [1.0, 1.0]) for k in range(3)], "image_id long, values array<double>")
    close(iterative.leading_components(same, 1)[1], [0.0])
    with pytest.raises(ValueError):
        iterative.leading_components(f.limit(0), 1)


def test_block_correlations_match_numpy(spark):
    r = np.random.default_rng(5)
    x, y = r.normal(size=(2, 12, 7)), r.normal(size=(2, 12, 5))
    x[0, :, 1] = 3.0
    y[1, 4, 2] = np.nan
    xs = frame(spark, [(s, t, i, float(x[s, t, i])) for s in range(2) for t in range(12) for i in range(7)], "s long, t long, i int, x double")
    cells = [(s, t, j, None if np.isnan(y[s, t, j]) else float(y[s, t, j])) for s in range(2) for t in range(12) for j in range(5)]
    ys = frame(spark, cells, "s long, t long, j int, y double")
    got = {(g["s"], g["i"], g["j"]): g["r"] for g in inference.block_correlations(xs, ys, "s", "t", 3).collect()}
    assert len(got) == 2 * 7 * 5
    for (s, i, j), v in got.items():
        there = ~np.isnan(y[s, :, j])
        want = 0.0 if (s, i) == (0, 1) else np.corrcoef(x[s, there, i], y[s, there, j])[0, 1]
        close(v, want)
    assert inference.block_correlations(xs.filter("s = 0"), ys.filter("s = 1"), "s", "t", 2).count() == 0


@pytest.mark.parametrize("held", [256 << 20, 64])
def test_two_sample_permutation_matches_numpy(spark, held, monkeypatch):
    monkeypatch.setattr(inference, "HELD_BYTES", held)
    r = np.random.default_rng(6)
    v = r.normal(size=(20, 4))
    rows = [(k, [None if (k, i) == (3, 2) else float(a) for i, a in enumerate(x)], k < 8) for k, x in enumerate(v)]
    f = frame(spark, rows, "image_id long, values array<double>, young boolean")
    got = inference.two_sample_permutation(f, F.col("young"), 200).orderBy("voxel_id").collect()
    v[3, 2] = np.nan
    close([g["stat"] for g in got], np.nanmean(v[:8], axis=0) - np.nanmean(v[8:], axis=0))
    assert [g["voxel_id"] for g in got] == [0, 1, 2, 3] and all(1 / 201 <= g["p"] <= 1 for g in got)
    shifted = f.withColumn("values", F.transform("values", lambda x: x + F.when(F.col("young"), 9.0).otherwise(0.0)))
    close([g["p"] for g in inference.two_sample_permutation(shifted, F.col("young"), 200).collect()], [1 / 201] * 4)


def test_weighted_sums_in_blocks_are_those_at_once(spark, monkeypatch):
    v = np.random.default_rng(7).normal(size=(30, 3))
    f = frame(spark, [(k, list(map(float, x))) for k, x in enumerate(v)], "image_id long, values array<double>")
    keys = ["replicate", "voxel_id"]
    whole = inference.weighted_sums(f, 10, inference.random_signs()).orderBy(*keys).toPandas()
    monkeypatch.setattr(inference, "HELD_BYTES", 48)
    blocks = inference.weighted_sums(f, 10, inference.random_signs()).orderBy(*keys).toPandas()
    assert len(whole) == 33 and (whole[keys] == blocks[keys]).all().all()
    close(whole[["total", "weight"]], blocks[["total", "weight"]])


def test_response_kernel_has_its_peak_and_undershoot():
    for model, peak in (("spm", 5), ("glover", 5)):
        k = series.response_kernel(1.0, model)
        close(sum(k), 1.0, 1e-9)
        assert k.index(max(k)) in (peak - 1, peak) and min(k) < 0


def test_bootstrap_splits_hold_out_about_a_third(spark):
    ids = spark.range(3000)
    got = inference.bootstrap_splits(ids, "id", 5).groupBy("replicate").agg(F.avg(F.col("held_out").cast("double")).alias("out"), F.avg("weight").alias("w")).collect()
    assert all(abs(r["out"] - math.exp(-1)) < 0.03 and abs(r["w"] - 1) < 0.08 for r in got)
    again = inference.bootstrap_splits(ids.repartition(7), "id", 5)
    assert again.exceptAll(inference.bootstrap_splits(ids, "id", 5)).count() == 0


def test_held_out_ridge_predictions(spark):
    r = np.random.default_rng(9)
    x, fold = r.normal(size=(60, 2)), np.arange(60) % 4
    y = x @ [2.0, -1.0] + 0.1 * r.normal(size=60)
    f = frame(spark, [(1, k, int(fold[k]), *map(float, x[k]), float(y[k])) for k in range(60)], "g int, id int, fold int, a double, b double, y double")
    fits = models.ridge_by_fold(f, ["a", "b"], "y", "fold", ["g"], [0.01])
    got = {q["id"]: q["predicted"] for q in models.with_fit(f, fits, ["a", "b"], "y", ["g", "fold"]).collect()}
    for k in range(60):
        t = fold != fold[k]
        close(got[k], x[k] @ np.linalg.solve(x[t].T @ x[t] + 0.01 * np.eye(2), x[t].T @ y[t]), 1e-8)


def test_simulated_numbers_are_normal_and_reproducible(spark):
    from tessera.operators import simulation

    v = np.array([r["x"] for r in spark.range(20_000).select(simulation.normal(3, "id").alias("x")).collect()])
    assert abs(v.mean()) < 0.03 and abs(v.std() - 1) < 0.03 and len(set(v)) > 19_990
    rates = simulation.detection_rates(simulation.noise_grid(spark, 12, 15, 4, 2.0, 1.0, runs=3), 3.0).collect()
    assert all(r["tpr"] > 0.9 and r["fpr"] < 0.05 for r in rates)
