"""All pairs by blocks against plain loops."""

import numpy as np
import pytest
from conftest import TINY

from tessera.operators import pairs
from tessera.plans import registry


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(pairs, "DEALT_ROWS", 8)
    monkeypatch.setattr(pairs, "TILE", 12)
    monkeypatch.setattr(pairs, "WIDE", 4)


def test_measures_of_all_pairs(spark, small_blocks):
    x = np.random.default_rng(1).normal(size=(40, 9))
    x[3], x[7] = x[5], 2.0
    rows = [(n * 3 - 20, v.tolist()) for n, v in enumerate(x)]
    frame = spark.createDataFrame([*rows, (500, None), (501, [1.0, None, *[0.0] * 7]), (None, x[0].tolist())], "image_id long, values array<double>")
    d = x[:, None] - x
    with np.errstate(invalid="ignore"):
        r = np.nan_to_num(np.corrcoef(x))
    want = {"euclidean": np.sqrt((d**2).sum(2)), "cityblock": np.abs(d).sum(2), "chebyshev": np.abs(d).max(2), "correlation": 1 - r}
    for how, full in want.items():
        got = {(g["i"], g["j"]): g["value"] for g in pairs.image_pairs(frame, pairs.DISTANCES[how]).collect()}
        assert len(got) == 42 * 41 // 2
        for a in range(40):
            for b in range(a + 1, 40):
                assert abs(got[rows[a][0], rows[b][0]] - full[a, b]) < 1e-6
        assert got[500, 501] is None and got[rows[0][0], 500] is None and got[rows[0][0], 501] is None
    got = {(g["part"], g["i"], g["j"]): g["value"] for g in pairs.image_pairs(frame, pairs.regional_euclidean(4), region="part").collect()}
    assert len(got) == 3 * 42 * 41 // 2 and abs(got[2, -20, -17] - abs(x[0, 8] - x[1, 8])) < 1e-6
    assert pairs.image_pairs(frame.limit(0), pairs.products).collect() == []


def test_differences_of_pairs_of_groups(spark, small_blocks):
    r = np.random.default_rng(2)
    rows = [(int(r.integers(0, 3)), n, round(float(r.normal()), 2), int(r.integers(0, 3))) for n in range(90)]
    odd = [(0, 900, None, 1), (0, 901, 1.0, None), (None, 902, 1.0, 1), (0, None, 1.0, 1)]
    got = pairs.differences(spark.createDataFrame([*rows, *odd], "g int, k long, x double, y int"), "x", "y", "g", "k", 6).collect()
    known = [*rows, odd[0]]
    want = {(a[0], a[1], b[1]): (None if b[2] is None else round(a[2] - b[2], 6), float(np.sign(a[3] - b[3]))) for a in known for b in known if a[0] == b[0] and a[1] < b[1] and a[3] != b[3]}
    assert {(x["g"], x["ka"], x["kb"]): (x["dx"], x["label"]) for x in got} == want
    assert len(got) == len(want)


def test_no_pair_is_a_row_of_a_join(spark):
    for name in ("distance_chebyshev", "distance_by_roi", "similarity_dot", "similarity_spearman", "transform_pairs_all"):
        plan = registry.QUERIES[name](spark, TINY)._jdf.queryExecution().optimizedPlan().toString()
        assert "block_" in plan and "Join" not in plan


def test_copies_do_not_fill_the_shuffle():
    assert [pairs.block_count(n, 64) for n in (0, 500, 10_256, 102_560)] == [1, 2, 12, 12]
    assert pairs.block_count(615_360, 64) == 38 and pairs.block_count(1000, 200_000) == 24
    assert pairs.block_count(36_000, 1, 25) == 3


def test_halves_are_rounded_away_from_zero():
    assert pairs.rounded(np.array([0.5, 1.5, -0.5, -1.49, -0.0]), 0).tolist() == [1.0, 2.0, -1.0, -1.0, 0.0]


def test_distances_in_spheres_are_summed_up_where_they_are_made(spark, small_blocks, monkeypatch):
    from tessera.operators import searchlight, spatial

    monkeypatch.setattr(searchlight, "IMAGES", 3)
    monkeypatch.setattr(searchlight, "CENTRES", 5)
    x = np.random.default_rng(5).normal(size=(20, 8))
    labels = [None if n % 4 == 0 else n % 3 for n in range(20)]
    frame = spark.createDataFrame([(n, labels[n], v.tolist()) for n, v in enumerate(x)], "image_id long, label int, values array<double>")
    made = searchlight.searchlight_distance_summary(frame, spatial.grid(spark, 2), 1.0, "label")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" not in plan
    every = searchlight.searchlight_distances(frame, spatial.grid(spark, 2), 1.0).collect()
    want = {}
    for g in every:
        want.setdefault((g["center_id"], labels[g["i"]] == labels[g["j"]]), []).append(g["value"])
    got = {(g["center_id"], g["same"]): (g["pairs"], g["mean"], g["nearest"], g["farthest"]) for g in made.collect()}
    assert got.keys() == want.keys() and len(every) == 8 * 190
    for k, v in want.items():
        np.testing.assert_allclose(got[k], (len(v), np.mean(v), min(v), max(v)), atol=1e-12)


def test_four_pieces_of_isc_fit_an_executor():
    from tessera.operators import inference

    assert 4 * 300 * inference.PIECE < 2e9  # a value took about 300 bytes of a worker


@pytest.mark.parametrize("shape", [(64, 2048), (77, 3001), (3, 5), (20000, 2)])
def test_passes_over_pairs_stay_in_the_cache_and_give_the_same_numbers(shape):
    r = np.random.default_rng(5)
    x, y = r.normal(size=(shape[0], 6)), r.normal(size=(shape[1], 6))
    seen = []

    def add(total, gap):
        seen.append(gap.size)
        np.add(total, np.abs(gap), out=total)

    got = pairs._gaps(x, y, add, range(6))
    assert max(seen) <= pairs.CACHED  # a tile's differences were made in one go, out of the cache
    want = np.zeros(shape)
    for k in range(6):
        want += np.abs(x[:, k][:, None] - y[:, k])
    np.testing.assert_array_equal(got, want)
    np.testing.assert_array_equal(pairs.cityblock(x, y), want)
    np.testing.assert_array_equal(pairs.rounded(want), pairs._rounded(want, 6))


@pytest.mark.parametrize("one", [False, True])
def test_tables_of_sphere_distances_have_mostly_one_name_a_side(monkeypatch, one):
    from types import SimpleNamespace

    from tessera.operators import searchlight

    monkeypatch.setattr(searchlight, "IMAGES", 16)
    monkeypatch.setattr(searchlight, "ACROSS", 32)
    r = np.random.default_rng(6)
    names = np.r_[r.integers(0, 4, 390), np.arange(10, 20)]  # four of many rows, ten of one
    ids = np.arange(400)
    ids[7] = ids[9]  # rows of equal keys make no pair
    left, right = (np.arange(400),) * 2 if one else (np.arange(150), np.arange(150, 400))
    met, whole, tables = [], 0, 0
    for p, q, parts in searchlight._named_tiles(SimpleNamespace(ids=ids, left=left, right=right, one=one), names):
        tables, whole = tables + 1, whole + (parts[0][1] is None)
        for k, at in parts:
            i, j = np.divmod(np.arange(len(p) * len(q)) if at is None else at, len(q))
            assert ((names[p[i]] == names[q[j]]) == k).all()
            met += [(*sorted(pair), k) for pair in zip(p[i].tolist(), q[j].tolist(), strict=True)]
    want = {(a, b) for a in left.tolist() for b in right.tolist() if ids[a] != ids[b] and (a < b or not one)}
    assert len(met) == len(want) and {m[:2] for m in met} == want
    assert whole > 0.6 * tables
    x = r.normal(size=(400, 7))
    x[300] = x[3]
    spheres = searchlight.Spheres(x, np.array([0, 1, 2, 4, 5, 6]), np.array([0, 2, 6]), "euclidean")
    for own, made in zip(([0, 1], [2, 4, 5, 6]), spheres.squares(np.arange(90), np.arange(90, 400)), strict=True):
        np.testing.assert_allclose(made, ((x[:90, None, own] - x[None, 90:, own]) ** 2).sum(axis=2), rtol=1e-9)
        assert made[3, 210] == 0.0


def test_pairs_leave_a_task_by_value_where_many_values_come_again(spark, monkeypatch):
    monkeypatch.setattr(pairs, "DEALT_ROWS", 2000)  # one block
    x = np.random.default_rng(7).integers(0, 100_000, 1000).astype(float)
    frame = spark.createDataFrame([*((n, [float(v)]) for n, v in enumerate(x)), (1000, None)], "image_id long, values array<double>")
    got = pairs.image_pairs(frame, pairs.euclidean).toPandas()
    assert len(got) == 1001 * 1000 // 2 and not got.duplicated(["i", "j"]).any() and (got["i"] < got["j"]).all()
    there = got[got["j"] < 1000]
    np.testing.assert_array_equal(there["value"], np.abs(x[there["i"]] - x[there["j"]]))
    assert got["value"][got["j"] == 1000].isna().all()
    assert (np.diff(there["value"]) >= 0).all()


def test_places_by_value(monkeypatch):
    few = np.arange(400_000) % 60_000 / 1e6  # what a file numbers stays where it is
    assert pairs._by_value(few, None, 6) is None
    monkeypatch.setattr(pairs, "NUMBERED", 1)
    value = np.array([3.0, 1.0, 3.0, 1.0, 1.0, 3.0, 1.0, 3.0, 1.0, 3.0]) / 1e6
    assert pairs._by_value(value, None, 6).tolist() == [1, 3, 4, 6, 8, 0, 2, 5, 7, 9]
    assert pairs._by_value(value, np.array([0, 1, 2, 3, 4, 5, 6, 7]), 6).tolist() == [1, 3, 4, 6, 0, 2, 5, 7]
    for odd in (np.arange(10.0), np.r_[value, np.inf], np.r_[value, np.nan], np.r_[value, 1e200], value[:0]):  # nothing comes again, or no codes
        at = np.arange(len(odd))[::-1]
        assert pairs._by_value(odd, None, 6) is None and pairs._by_value(odd, at, 6) is at


def test_blocks_without_rows(spark):
    rows = [(0, n, float(n), n % 3) for n in range(600)] + [(1, 700, 1.0, 0), (2, 701, 1.0, 0), (2, 702, 3.0, 1)]
    got = pairs.differences(spark.createDataFrame(rows, "g int, k long, x double, y int"), "x", "y", "g", "k").collect()
    assert len(got) == 3 * 200 * 200 + 1
    assert [(r["ka"], r["kb"], r["dx"], r["label"]) for r in got if r["g"] != 0] == [(701, 702, -2.0, -1.0)]
    frame = spark.createDataFrame([(7, [1.0, 2.0])] * 300 + [(8, [1.0, 3.0])], "image_id long, values array<double>")
    assert [tuple(r) for r in pairs.image_pairs(frame, pairs.euclidean).collect()] == [(7, 8, 1.0)] * 300
