"""Queries over whole tables, against numpy."""

import numpy as np
import pyarrow.parquet as pq
import pytest

import tessera.plans  # noqa: F401
from tessera.operators import alignment, matrices
from tessera.plans import registry

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def embeddings():
    t = pq.read_table(f"{TINY}/embeddings.parquet").to_pandas().sort_values("vec_id")
    return t["vec_id"].to_numpy(), t["label"].to_numpy(), np.stack(t["embedding"].to_list()).astype(float)


@pytest.mark.parametrize("block", [512, 64])
def test_all_pairs_of_images(spark, embeddings, monkeypatch, block):
    monkeypatch.setattr(matrices, "BLOCK", block)
    ids, _, v = embeddings
    i, j = np.triu_indices(len(ids), 1)
    frame = registry.QUERIES["similarity_correlation_all"](spark, TINY)
    assert "NestedLoop" not in frame._jdf.queryExecution().toString()
    got = frame.toPandas().sort_values(["i", "j"])
    assert got["i"].tolist() == ids[i].tolist() and got["j"].tolist() == ids[j].tolist()
    np.testing.assert_allclose(got["value"], np.corrcoef(v)[i, j], atol=1e-6)


def test_all_pairs_of_images_by_roi(spark, embeddings):
    ids, _, v = embeddings
    got = registry.QUERIES["distance_by_roi_all"](spark, TINY).toPandas().sort_values(["roi", "i", "j"])
    i, j = np.triu_indices(len(ids), 1)
    assert len(got) == 8 * len(i)
    np.testing.assert_allclose(got["value"][got["roi"] == 3], np.linalg.norm(v[i, 24:32] - v[j, 24:32], axis=1), atol=1e-6)


def test_subjects_keep_all_voxels_and_times(spark, embeddings):
    ids, label, v = embeddings
    n = {s: int((label == s).sum()) for s in set(label.tolist())}
    shared = min(n.values())
    cube = {s: v[label == s] for s in n}
    got = {(r["subject"], r["voxel_id"]): r["r"] for r in registry.QUERIES["isc_leave_one_out_all"](spark, TINY).collect()}
    assert len(n) > 1 and len(set(n.values())) > 1 and set(got) == {(s, k) for s in n for k in range(64)}
    for s in n:
        rest = [cube[o] for o in n if o != s]
        t = [k for k in range(n[s]) if any(len(o) > k for o in rest)]
        others = np.array([np.mean([o[k] for o in rest if len(o) > k], axis=0) for k in t])
        np.testing.assert_allclose([got[s, k] for k in (0, 40)], [np.corrcoef(cube[s][t, k], others[:, k])[0, 1] for k in (0, 40)], atol=1e-6)
    assert len(registry.QUERIES["isc_bootstrap"](spark, TINY).collect()) == 64
    assert {np.shape(r["shared"]) for r in registry.QUERIES["align_det_srm"](spark, TINY).collect()} == {(4, shared)}
    assert registry.QUERIES["align_regions"](spark, TINY).count() == len(ids) * 64


def test_regions_of_unequal_subjects_are_aligned(spark):
    r = np.random.default_rng(11)
    base = r.normal(size=(30, 3))
    turn = np.linalg.qr(r.normal(size=(3, 3)))[0]
    cubes = {0: base, 1: (base @ turn)[:24], 2: (base @ turn.T)[:, :2]}
    rows = [(s, 0, k, t, float(x[t, k])) for s, x in cubes.items() for t in range(len(x)) for k in range(x.shape[1])]
    got = alignment.align_regions(spark.createDataFrame(rows, "subject int, roi int, voxel_id long, t long, value double"), rounds=10).toPandas()
    out = {s: g.pivot(index="t", columns="voxel_id", values="value").to_numpy() for s, g in got.groupby("subject")}
    assert {s: x.shape for s, x in out.items()} == {0: (30, 3), 1: (24, 3), 2: (30, 3)}
    a, b = out[0][:24], out[1]
    assert np.corrcoef(a.ravel(), b.ravel())[0, 1] > 0.97


def test_pairs_normalisation_and_groups_of_whole_tables(spark, embeddings):
    _, label, v = embeddings
    got = registry.QUERIES["image_pair_sub_all"](spark, TINY).toPandas().sort_values(["image_id", "voxel_id"])
    np.testing.assert_allclose(got["value"], (v[0::2] - v[1::2]).ravel(), atol=1e-6)
    got = registry.QUERIES["column_correlations_all"](spark, TINY).toPandas().sort_values(["i", "j"])
    np.testing.assert_allclose(got["r"], np.corrcoef(v.T)[np.triu_indices(64, 1)], atol=1e-6)
    got = registry.QUERIES["cv_normalize_all"](spark, TINY).toPandas().sort_values(["image_id", "voxel_id"])
    fold = np.arange(len(v)) % 5
    want = np.stack([(x - v[fold != f].mean(axis=0)) / v[fold != f].std(axis=0) for x, f in zip(v, fold, strict=True)])
    np.testing.assert_allclose(got["value"], want.ravel(), atol=1e-6)
    got = registry.QUERIES["permutation_two_sample_all"](spark, TINY).toPandas().sort_values("voxel_id")
    np.testing.assert_allclose(got["stat"], v[label < 5].mean(axis=0) - v[label >= 5].mean(axis=0), atol=1e-6)


def test_pairs_of_all_customers(spark):
    c = pq.read_table(f"{TINY}/customer.parquet").to_pandas()
    rows = list(c[["c_nationkey", "c_custkey", "c_mktsegment"]].itertuples(index=False))
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[2] != y[2]}
    got = {(r["ka"], r["kb"]) for r in registry.QUERIES["transform_pairs_all"](spark, TINY).collect()}
    assert got == want
    assert any(k % 4 for pair in want for k in pair)


def test_transform_pairs_reads_every_customer(spark):
    from tessera.plans import rank_queries

    n = registry.QUERIES["transform_pairs_all"](spark, TINY).count()
    assert rank_queries.transform_pairs(spark, TINY).count() == registry.QUERIES["transform_pairs"](spark, TINY).count() == n
    assert registry.ORACLE_SQL["transform_pairs"] == registry.ORACLE_SQL["transform_pairs_all"] and "%" not in registry.ORACLE_SQL["transform_pairs"]
