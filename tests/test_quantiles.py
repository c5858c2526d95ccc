"""Quantiles of groups without a task that has a group's values."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import series


def test_quantiles_agree_with_percentiles_and_no_task_gathers_a_group(spark):
    r = np.random.default_rng(6)
    rows = [(int(g), None if g == 2 else float(x)) for g, x in zip(r.integers(0, 4, 300), np.round(r.normal(size=300), 1), strict=True)]
    frame = spark.createDataFrame([*rows, (0, None), (None, 5.0), (9, 7.0)], "g int, x double")
    made = series.quantiles(frame, "x", ["g"], lo=0.05, hi=0.95)
    assert "percentile" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {x["g"]: (x["lo"], x["hi"]) for x in made.collect() if x["g"] is not None}
    want = frame.filter("g IS NOT NULL").groupBy("g").agg(F.percentile("x", 0.05).alias("lo"), F.percentile("x", 0.95).alias("hi"))
    for x in want.collect():
        if x["lo"] is None:
            assert got[x["g"]] == (None, None)
        else:
            np.testing.assert_allclose(got[x["g"]], (x["lo"], x["hi"]), atol=1e-12)
    assert len(got) == want.count() == 5
    whole = series.quantiles(frame, "x", [], half=0.5).first()["half"]
    np.testing.assert_allclose(whole, np.median([x for _, x in rows if x is not None] + [5.0, 7.0]), atol=1e-12)
    kept = series.winsorize(frame, "x", ["g"], to_cutoff=False)
    assert kept.count() == 302 and "percentile" not in kept._jdf.queryExecution().optimizedPlan().toString().lower()


def test_fits_are_sent_to_the_rows(spark):
    from tessera.plans import registry

    plan = registry.QUERIES["ols_residuals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
