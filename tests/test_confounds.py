"""Confounds by strategy, censored samples and what is left of them."""

import numpy as np
import pytest

from tessera.operators import confounds


def table(spark, runs):
    rows = [(path, k, v) for path, samples in runs.items() for k, v in enumerate(samples)]
    return spark.createDataFrame(rows, "path string, row_id long, values map<string, double>").repartition(3)


def kept(frame):
    out: dict = {}
    for r in sorted(frame.collect(), key=lambda r: r["row_id"]):
        out.setdefault(r["path"], []).append(r["kept"])
    return out


def stretches(bad, least):
    """sample by sample: good ones of stretches that are long enough."""
    out, at = [False] * len(bad), 0
    while at < len(bad):
        end = at
        while end < len(bad) and not bad[end]:
            end += 1
        if end - at >= least:
            out[at:end] = [True] * (end - at)
        at = max(end, at + 1)
    return out


@pytest.mark.parametrize("least", [0, 1, 3, 5])
def test_short_stretches_go_with_what_is_bad(spark, least):
    r = np.random.default_rng(least)
    runs = {f"r{k}": (r.random(40) < (0, 0.1, 0.3, 1)[k]).tolist() for k in range(4)}
    f = table(spark, {p: [{confounds.DISPLACEMENT: 0.9 if b else 0.1} for b in bad] for p, bad in runs.items()})
    assert kept(confounds.sample_masks(f, least=least)) == {p: stretches(b, max(least, 1)) for p, b in runs.items()}


def test_limits_and_onset(spark):
    samples = [
        {"non_steady_state_outlier00": 1.0, "framewise_displacement": None},
        {"non_steady_state_outlier00": 0.0, "framewise_displacement": 0.5, "std_dvars": 1.5},
        {"framewise_displacement": 0.51},
        {"std_dvars": 1.6},
        {"std_dvars": None},
        None,
    ]
    f = table(spark, {"a": samples})
    assert kept(confounds.sample_masks(f, least=0)) == {"a": [False, True, False, False, True, True]}
    assert kept(confounds.sample_masks(f, None, None, 0)) == {"a": [False, True, True, True, True, True]}
    assert confounds.sample_masks(f.limit(0)).count() == 0


def test_columns_by_strategy_less_their_means_over_kept_samples(spark):
    a = [{"trans_x": float(k), "trans_x_derivative1": None if k == 0 else 1.0, "rot_z_power2": 2.0, "csf": 3.0, "csf_wm": 9.0, "cosine00": 0.0, "global_signal": 1.0} for k in range(4)]
    b = [{"csf": None, "white_matter": 5.0}, {"csf": None, "white_matter": 7.0}]
    f = table(spark, {"a": a, "b": b, "c": [{"other": 1.0}]}).selectExpr("*", "NOT (path = 'a' AND row_id = 3) AS kept")
    chosen = {"motion": "derivatives", "wm_csf": "basic"}
    raw = {(r["path"], r["row_id"]): r["values"] for r in confounds.select_confounds(f, chosen, demean=False).collect()}
    assert raw["a", 0] == {"trans_x": 0.0, "trans_x_derivative1": None, "csf": 3.0}
    assert raw["b", 1] == {"csf": None, "white_matter": 7.0} and raw["c", 0] == {}
    got = {(r["path"], r["row_id"]): (r["kept"], r["values"]) for r in confounds.select_confounds(f, chosen).collect()}
    assert len(got) == 7 and not got["a", 3][0]
    # means are over rows 0 to 2; a missing value is the mean
    assert got["a", 0][1] == {"trans_x": -1.0, "trans_x_derivative1": 0.0, "csf": 0.0}
    assert got["a", 3][1] == {"trans_x": 2.0, "trans_x_derivative1": 0.0, "csf": 0.0}
    assert got["b", 0][1] == {"csf": None, "white_matter": -1.0} and got["c", 0][1] == {}
    full = {(r["path"], r["row_id"]): set(r["values"]) for r in confounds.select_confounds(f, {"motion": "full", "high_pass": "", "global_signal": "basic"}).collect()}
    assert full["a", 0] == {"trans_x", "trans_x_derivative1", "rot_z_power2", "cosine00", "global_signal"}


def test_a_run_without_kept_samples_has_nulls(spark):
    f = table(spark, {"a": [{"csf": 1.0}, {"csf": 2.0}]}).selectExpr("*", "false AS kept")
    assert [r["values"] for r in confounds.select_confounds(f, {"wm_csf": "basic"}).collect()] == [{"csf": None}] * 2


def test_what_runs_lack_is_named_and_bad_names_are_refused(spark):
    f = table(spark, {"a": [{"csf": 1.0, "cosine00": 1.0}], "b": [{"rot_x": 1.0}, {"rot_x": 1.0, "cosine01": 2.0}]})
    got = {(r["path"], r["strategy"]) for r in confounds.missing_strategies(f, {"motion": "basic", "wm_csf": "basic", "high_pass": ""}).collect()}
    assert got == {("a", "motion"), ("b", "wm_csf")}
    with pytest.raises(ValueError, match="none of"):
        confounds.select_confounds(f, {"breath": "basic"})
    with pytest.raises(ValueError, match="none of"):
        confounds.missing_strategies(f, {"motion": "cubed"})
