"""Stacks of matrices: arithmetic, edge tests by sign flips, bootstraps, round robins, against numpy."""

import math

import numpy as np
import pytest

from tessera.operators import adjacency as op


def stack(spark, m=40, nodes=6, seed=3):
    """m matrices of all edges of the nodes, with their values as (edge, matrix)."""
    rng = np.random.default_rng(seed)
    ends = [(i, j) for i in range(nodes) for j in range(i + 1, nodes)]
    x = rng.normal(0.2, 1, (len(ends), m))
    rows = [(k, i, j, float(x[e, k])) for e, (i, j) in enumerate(ends) for k in range(m)]
    return spark.createDataFrame(rows, "matrix_id long, i int, j int, value double").repartition(7), ends, x


def plain():
    """Sign flips and counts that a loop can make too; nested, so that workers get them by value."""

    def mixed(ids, replicates):
        return ((ids[None, :] + 1) * 31 + replicates[:, None] * (ids[None, :] % 7 + 1) * 17) % 101

    def signs(ids, replicates):
        s = 1.0 - 2.0 * (mixed(ids, replicates) % 2)
        s[replicates == 0] = 1.0
        return s

    def counts(ids, replicates):
        w = (mixed(ids, replicates) % 3).astype(float)
        w[replicates == 0] = 1.0
        return w

    return signs, counts


@pytest.mark.parametrize("step", [None, 5])
def test_edge_permutation_is_plain_sign_flips(spark, monkeypatch, step):
    adj, ends, x = stack(spark)
    signs, _ = plain()
    if step:  # several pieces of one edge in a task
        monkeypatch.setattr(op, "WEIGHT_BYTES", step * 8 * 208)
    got = {(r["i"], r["j"]): r for r in op.edge_permutation(adj, 199, signs).collect()}
    flips = signs(np.arange(x.shape[1]), np.arange(200))
    assert len(got) == len(ends)
    for e, at in enumerate(ends):
        means = (flips * x[e]).mean(axis=1)
        assert got[at]["n"] == 40 and got[at]["stat"] == pytest.approx(x[e].mean())
        assert got[at]["p"] == pytest.approx(((np.abs(means[1:]) >= abs(means[0]) - 1e-12).sum() + 1) / 200)


def test_edge_permutation_tells_an_effect_from_none(spark):
    rows = [(k, 0, 1, 1.0 + 0.1 * (k % 5)) for k in range(30)] + [(k, 0, 2, float((-1) ** k)) for k in range(30)]
    got = {r["j"]: r["p"] for r in op.edge_permutation(spark.createDataFrame(rows, "matrix_id long, i int, j int, value double"), 499).collect()}
    assert got[1] < 0.01 and got[2] == 1.0


@pytest.mark.parametrize("how, piece", [*((h, 4096) for h in ("mean", "sum", "std", "min", "max", "median")), ("median", 3)])
def test_edge_bootstrap_is_plain_resampling(spark, monkeypatch, how, piece):
    monkeypatch.setattr(op, "PIECE", piece)
    adj, ends, x = stack(spark, m=25)
    _, counts = plain()
    got = {(r["i"], r["j"]): r for r in op.edge_bootstrap(adj, how, 99, counts).collect()}
    w = counts(np.arange(25), np.arange(100)).astype(int)
    for e, at in enumerate(ends):
        drawn = np.array([getattr(np, how)(np.repeat(x[e], w[r])) for r in range(100) if w[r].any()])  # empty draws are left out
        want = [drawn[0], drawn[1:].mean(), drawn[1:].std(ddof=1), *np.percentile(drawn[1:], (2.5, 97.5))]
        assert [got[at][c] for c in ("stat", "mean", "std", "lo", "hi")] == pytest.approx(want)
        assert got[at]["p"] == pytest.approx(math.erfc(abs(want[1] / want[2]) / math.sqrt(2)))


def test_missing_edges_are_left_out(spark):
    schema = "matrix_id string, i int, j int, value double, extra string"
    rows = [("a", 0, 1, 1.0, "x"), ("b", 0, 1, None, "x"), ("c", 0, 1, float("nan"), None), ("d", 0, 1, 3.0, None), ("a", 0, 2, None, "y"), (None, 1, 2, 5.0, "z")]
    adj = spark.createDataFrame(rows, schema)
    got = {(r["i"], r["j"]): (r["n"], r["stat"]) for r in op.edge_permutation(adj, 19).collect()}
    assert got == {(0, 1): (2, 2.0), (1, 2): (1, 5.0)}
    boot = {(r["i"], r["j"]): r for r in op.edge_bootstrap(adj, "max", 50).collect()}
    assert boot[0, 1]["stat"] == 3.0 and boot[1, 2]["lo"] == boot[1, 2]["hi"] == 5.0 and boot[1, 2]["std"] == 0.0
    gone = op.edge_bootstrap(adj, "mean", 3, lambda ids, numbers: np.where(numbers[:, None] == 0, 1.0, 0.0) * np.ones(len(ids))).collect()
    assert {r["stat"] for r in gone} == {2.0, 5.0} and {r["mean"] for r in gone} == {None}
    middle = {(r["i"], r["j"]): r for r in op.edge_bootstrap(adj, "median", 50).collect()}
    assert {k: r["stat"] for k, r in middle.items()} == {(0, 1): 2.0, (1, 2): 5.0} and middle[1, 2]["lo"] == middle[1, 2]["hi"] == 5.0
    once = lambda ids, numbers: np.where(numbers[:, None] == 0, 1.0, 0.0) * np.ones(len(ids))
    gone = op.edge_bootstrap(adj, "median", 40, once).collect()
    assert {r["stat"] for r in gone} == {2.0, 5.0} and {r["mean"] for r in gone} == {None}
    none = adj.limit(0)
    assert op.edge_bootstrap(none, "median", 9).count() == 0
    assert op.edge_permutation(none, 9).count() == 0 and op.edge_bootstrap(none, "std", 9).count() == 0
    with pytest.raises(ValueError):
        op.edge_bootstrap(adj, "mode")


def test_arithmetic(spark):
    schema = "matrix_id int, i int, j int, value double"
    a = spark.createDataFrame([(0, 0, 1, 4.0), (0, 0, 2, 0.0), (1, 0, 1, None)], schema)
    b = spark.createDataFrame([(0, 0, 1, 2.0), (0, 0, 2, 0.0), (2, 0, 1, 1.0)], schema)
    value = lambda f: {(r["matrix_id"], r["j"]): r["value"] for r in f.collect()}
    assert value(op.arithmetic(a, "div", 2)) == {(0, 1): 2.0, (0, 2): 0.0, (1, 1): None}
    assert value(op.arithmetic(a, "div", 2, reverse=True)) == {(0, 1): 0.5, (0, 2): None, (1, 1): None}
    assert value(op.arithmetic_matrices(a, b, "div")) == {(0, 1): 2.0, (0, 2): None, (1, 1): None, (2, 1): None}
    assert value(op.arithmetic_matrices(a, b, "sub")) == {(0, 1): 2.0, (0, 2): 0.0, (1, 1): None, (2, 1): None}


def test_reliabilities_of_planted_effects(spark):
    rng = np.random.default_rng(8)
    rows = []
    for m in range(12):
        actor, partner = rng.normal(0, 2, 30), rng.normal(0, 1, 30)
        rows += [(m, i, j, float(5 + actor[i] + partner[j] + rng.normal(0, 0.5))) for i in range(30) for j in range(30) if i != j]
    shares = op.relation_shares(spark.createDataFrame(rows, "matrix_id int, i int, j int, value double"))
    first = shares.orderBy("matrix_id").first()
    assert first["total"] == pytest.approx(first["actor"] + first["partner"] + first["relationship"])
    assert first["actor_reliability"] > 0.98 and 0.95 < first["partner_reliability"] < 1
    assert first["dyad_r"] == pytest.approx(first["dyad"] / first["relationship"])
    got = {r["component"]: r for r in op.summarize_relations(shares).collect()}
    assert 3 < got["actor"]["estimate"] < 5.5 and 0.6 < got["partner"]["estimate"] < 1.5
    assert got["actor"]["p"] < 1e-4 and got["relationship"]["estimate"] == pytest.approx(0.25, abs=0.03) and got["dyad"]["p"] > 0.001
    # one-sided p of a variance is half the two-sided one of its t
    from tessera.functions.distributions import t_sf2

    t = np.array([got["actor"]["t"]])
    assert got["actor"]["p"] == pytest.approx(float(t_sf2(t, np.array([11.0]))[0]) / 2)


def test_one_group_has_an_estimate_and_no_test(spark):
    rng = np.random.default_rng(1)
    rows = [(0, i, j, float(rng.normal())) for i in range(6) for j in range(6) if i != j]
    for r in op.summarize_relations(op.relation_shares(spark.createDataFrame(rows, "matrix_id int, i int, j int, value double"))).collect():
        assert r["n"] == 1 and r["estimate"] is not None and r["se"] is r["t"] is r["p"] is None
