"""Places in an order and order statistics, without a group in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import images, ranks
from tessera.sources import scratch


def test_places_are_row_numbers(spark):
    r = np.random.default_rng(1)
    rows = [(None if g == 3 else int(g), int(x), int(k)) for k, (g, x) in enumerate(zip(r.integers(0, 4, 900), r.integers(0, 50, 900), strict=True))]
    rows += [(0, None, 1000), (0, None, 1001)]
    frame = spark.createDataFrame(rows, "g int, x int, k long")
    for by in ([], ["g"]):
        got = {x["k"]: (x["place"], x["n"]) for x in ranks.ordered_places(frame, by, ["x", "k"], "place", "n").collect()}
        groups = {}
        for row in rows:
            groups.setdefault(row[0] if by else 0, []).append(row)
        for members in groups.values():
            members.sort(key=lambda m: (m[1] is not None, m[1] or 0, m[2]))
            assert [got[m[2]] for m in members] == [(n + 1, len(members)) for n in range(len(members))]
    plan = ranks.ordered_places(frame, ["g"], ["x"])
    assert plan.columns == ["g", "x", "k", "place"] and ranks.ordered_places(frame.limit(0), ["g"], ["x"]).collect() == []
    scratch.drop(plan)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        plan.count()


def test_folds_of_groups_smaller_than_folds(spark):
    frame = spark.createDataFrame([(g, k) for g, n in ((0, 3), (1, 5), (2, 12)) for k in range(n)], "g int, k int")
    got = {(x["g"], x["k"]): x["fold"] for x in ranks.contiguous_folds(frame, "k", 5, ["g"]).collect()}
    for g, n in ((0, 3), (1, 5), (2, 12)):
        sizes = [n // 5 + (f < n % 5) for f in range(5)]
        assert [got[g, k] for k in range(n)] == [f for f, size in enumerate(sizes) for _ in range(size)]


def test_order_statistics_by_buckets(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=2000), np.full(500, 0.25), [1e12, -1e9], 0.25 + np.arange(30) * 5e-17])
    rows = [(n, [float(v) for v in part]) for n, part in enumerate(np.array_split(r.permutation(x), 40))]
    frame = spark.createDataFrame([*rows, (99, None), (98, [float("nan"), None])], "image_id long, values array<double>").repartition(5)
    want = np.sort(x)
    places = [0, 5, 1300, len(x) - 1]
    assert images.value_at(frame, places) == want[places].tolist()
    monkeypatch.setattr(images, "SORTED", 10)
    monkeypatch.setattr(images, "BUCKETS", 8)
    assert images.value_at(frame, places) == want[places].tolist()
    with pytest.raises(ValueError, match="beyond"):
        images.value_at(frame, [len(x)])
    cut = np.percentile(x, 30)
    got = images.threshold_percentile(frame.filter("image_id < 90"), 30).orderBy("image_id").collect()
    assert got[0]["values"] == [v if v >= cut else 0.0 for v in rows[0][1]]
    none = images.threshold_percentile(frame.filter("image_id = 99"), 30)
    assert none.collect()[0]["values"] is None
    assert images.threshold_percentile(frame.filter(F.lit(False)), 30).collect() == []


def tau_of_pairs(x, y):
    a, b = (np.sign(np.subtract.outer(v, v))[np.triu_indices(len(v), 1)] for v in (x, y))
    scale = np.sqrt(np.abs(a).sum() * np.abs(b).sum())
    return float((a * b).sum() / scale) if scale else 0.0


def test_kendall_counts_what_pairs_give(spark):
    r = np.random.default_rng(11)
    groups = {"big": (r.integers(0, 60, 400), r.integers(0, 45, 400)), "line": (np.arange(33), -np.arange(33)), "flat": (np.ones(5), np.arange(5)), "two": ([1, 2], [5, 9]), "same": ([3, 3], [4, 4])}
    groups["mixed"] = (r.normal(size=129), r.normal(size=129))
    rows = [(g, float(a), float(b)) for g, (x, y) in groups.items() for a, b in zip(x, y, strict=True)]
    rows += [("one", 1.0, 1.0), ("big", None, 1.0), ("big", 2.0, float("nan")), (None, 1.0, 2.0), (None, 2.0, 3.0)]
    f = spark.createDataFrame(rows, "g string, a double, b double").repartition(6)
    got = {q["g"]: q["tau"] for q in ranks.kendall(f, "a", "b", ["g"]).collect()}
    assert set(got) == set(groups)
    for g, (x, y) in groups.items():
        assert abs(got[g] - tau_of_pairs(np.asarray(x, float), np.asarray(y, float))) < 1e-12, g
    assert ranks.kendall(f.limit(0), "a", "b", ["g"]).count() == 0
    whole = ranks.kendall(f.filter("g = 'mixed'"), "a", "b", []).collect()
    assert [q.asDict() for q in whole] == [{"tau": got["mixed"]}]


def test_totals_before_a_row_of_a_group_in_many_parts(spark):
    rows = [("a", k, k % 4) for k in range(500)] + [("b", 3, 2), (None, 1, 7), (None, 2, 1)]
    f = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    got = {(q["g"], q["k"]): q["t"] for q in ranks.total_before(f, ["g"], ["k"], "v", "t").collect()}
    want, run = {}, {}
    for g, k, v in rows:
        want[g, k] = run.get(g, 0)
        run[g] = want[g, k] + v
    assert got == want
