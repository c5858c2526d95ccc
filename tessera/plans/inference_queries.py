"""Queries of permutation tests, bootstraps and inter-subject correlation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import r6
from tessera.operators import inference as op
from tessera.operators.matrices import full_square
from tessera.plans.image_queries import LONG
from tessera.plans.matrix_queries import ADJ, flows
from tessera.plans.registry import query
from tessera.sources.tables import images, table

N = 99


def rounded(frame, *columns):
    return frame.withColumns({c: r6(F.col(c)) for c in columns})


def plain_signs(ids, replicates):
    """Signs that SQL can make too."""
    s = 1.0 - 2.0 * ((ids[None, :] * 7919 + replicates[:, None] * (ids[None, :] % 31 + 1) * 104729) % 1000003 % 2)
    s[replicates == 0] = 1.0
    return s


@query(
    "permutation_one_sample",
    f"""WITH {LONG}, R AS (SELECT unnest(generate_series(0, {N})) AS replicate),
    S AS (SELECT replicate, voxel_id, avg(value * CASE WHEN replicate = 0 THEN 1 ELSE 1 - 2 * ((image_id * 7919 + replicate * (image_id % 31 + 1) * 104729) % 1000003 % 2) END) AS m
    FROM L, R GROUP BY ALL)
    SELECT o.voxel_id, round(o.m, 6) + 0.0 AS stat, round((count(*) FILTER (WHERE abs(s.m) >= abs(o.m) - 1e-12) + 1) / {N + 1}.0::DOUBLE, 6) + 0.0 AS p
    FROM S o JOIN S s ON o.voxel_id = s.voxel_id AND o.replicate = 0 AND s.replicate > 0 GROUP BY o.voxel_id, o.m""",
)
def permutation_one_sample(spark, d):
    made = op.one_sample_permutation(images(spark, d), N, plain_signs)
    return rounded(made, "stat", "p").withColumn("voxel_id", F.col("voxel_id").cast("long"))


@query("permutation_one_sample_random")
def permutation_one_sample_random(spark, d):
    return op.one_sample_permutation(images(spark, d), 999)


_ORDER = "(image_id * 7919 + replicate * (image_id % 31 + 1) * 104729) % 1000003"


@query(
    "permutation_two_sample",
    f"""WITH {LONG}, I AS (SELECT vec_id AS image_id, label < 2 AS first, embedding FROM embeddings WHERE label < 4), R AS (SELECT unnest(generate_series(0, {N})) AS replicate),
    P AS (SELECT replicate, image_id, row_number() OVER (PARTITION BY replicate ORDER BY CASE WHEN replicate = 0 THEN CASE WHEN first THEN 0 ELSE 1 END ELSE {_ORDER} END, NOT first, image_id)
          <= (SELECT count(*) FROM I WHERE first) AS one FROM I, R),
    M AS (SELECT replicate, voxel_id, avg(value) FILTER (WHERE one) - avg(value) FILTER (WHERE NOT one) AS m FROM L JOIN P USING (image_id) GROUP BY ALL)
    SELECT o.voxel_id, round(o.m, 6) + 0.0 AS stat, round((count(*) FILTER (WHERE abs(s.m) >= abs(o.m) - 1e-12) + 1) / {N + 1}.0::DOUBLE, 6) + 0.0 AS p
    FROM M o JOIN M s ON o.voxel_id = s.voxel_id AND o.replicate = 0 AND s.replicate > 0 GROUP BY o.voxel_id, o.m""",
)
def permutation_two_sample(spark, d):
    return two_samples(images(spark, d).filter("label < 4"), F.col("label") < 2)


def two_samples(i, first):
    image = F.col("id.image_id")
    mixed = (image * 7919 + F.col("replicate") * (image % 31 + 1) * 104729) % 1000003
    # a struct like the samples' own order, so that both can be one sort key
    order = F.struct(F.lit(False).alias("late"), mixed.alias("image_id"))
    return rounded(op.two_sample_permutation(i, first, N, order), "stat", "p").withColumn("voxel_id", F.col("voxel_id").cast("long"))


@query(
    "permutation_two_sample_all",
    f"""WITH {LONG}, I AS (SELECT vec_id AS image_id, label < 5 AS first, embedding FROM embeddings), R AS (SELECT unnest(generate_series(0, {N})) AS replicate),
    P AS (SELECT replicate, image_id, row_number() OVER (PARTITION BY replicate ORDER BY CASE WHEN replicate = 0 THEN CASE WHEN first THEN 0 ELSE 1 END ELSE {_ORDER} END, NOT first, image_id)
          <= (SELECT count(*) FROM I WHERE first) AS one FROM I, R),
    M AS (SELECT replicate, voxel_id, avg(value) FILTER (WHERE one) - avg(value) FILTER (WHERE NOT one) AS m FROM L JOIN P USING (image_id) GROUP BY ALL)
    SELECT o.voxel_id, round(o.m, 6) + 0.0 AS stat, round((count(*) FILTER (WHERE abs(s.m) >= abs(o.m) - 1e-12) + 1) / {N + 1}.0::DOUBLE, 6) + 0.0 AS p
    FROM M o JOIN M s ON o.voxel_id = s.voxel_id AND o.replicate = 0 AND s.replicate > 0 GROUP BY o.voxel_id, o.m""",
)
def permutation_two_sample_all(spark, d):
    return two_samples(images(spark, d), F.col("label") < 5)


@query(
    "permutation_correlation",
    f"""WITH B AS (SELECT c_custkey AS k, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer), R AS (SELECT unnest(generate_series(0, {N})) AS replicate),
    P AS (SELECT replicate, k, x, row_number() OVER (PARTITION BY replicate ORDER BY CASE WHEN replicate = 0 THEN k ELSE (k * 7919 + replicate * (k % 31 + 1) * 104729) % 1000003 END, k) AS place,
          row_number() OVER (PARTITION BY replicate ORDER BY k) AS old, y FROM B, R),
    C AS (SELECT a.replicate, corr(a.x, b.y) AS r FROM P a JOIN P b ON a.replicate = b.replicate AND a.place = b.old GROUP BY a.replicate)
    SELECT round(o.r, 6) + 0.0 AS stat, round((count(*) FILTER (WHERE abs(s.r) >= abs(o.r) - 1e-12) + 1) / {N + 1}.0::DOUBLE, 6) + 0.0 AS p FROM C o JOIN C s ON o.replicate = 0 AND s.replicate > 0 GROUP BY o.r""",
)
def permutation_correlation(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    order = (F.col("k") * 7919 + F.col("replicate") * (F.col("k") % 31 + 1) * 104729) % 1000003
    return rounded(op.correlation_permutation(c, "x", "y", "k", N, order), "stat", "p")


@query(
    "permutation_circle_shift",
    """WITH S AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, count(*) OVER (PARTITION BY label) AS n, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
    R AS (SELECT unnest(generate_series(0, 19)) AS replicate), C AS (SELECT a.label, replicate, corr(a.x, b.y) AS r FROM S a, R JOIN S b ON b.t = (a.t + replicate) % a.n AND a.label = b.label GROUP BY ALL)
    SELECT o.label, round(o.r, 6) + 0.0 AS stat, round((count(*) FILTER (WHERE abs(s.r) >= abs(o.r) - 1e-12) + 1) / 20.0::DOUBLE, 6) + 0.0 AS p
    FROM C o JOIN C s ON o.label = s.label AND o.replicate = 0 AND s.replicate > 0 GROUP BY o.label, o.r""",
)
def permutation_circle_shift(spark, d):
    e = images(spark, d)
    t = (F.row_number().over(Window.partitionBy("label").orderBy("image_id")) - 1).cast("long")
    s = e.select("label", t.alias("t"), F.get("values", F.lit(0)).alias("x"), F.get("values", F.lit(1)).alias("y"))
    return rounded(op.circle_shift_permutation(s, "x", "y", "t", range(1, 20), ["label"]), "stat", "p")


@query(
    "permutation_matrix",
    f"""WITH {ADJ}, X AS (SELECT i, j, sum(value) AS value FROM Q WHERE matrix_id IN ('BUILDING', 'MACHINERY') GROUP BY ALL), Y AS (SELECT i, j, sum(value) AS value FROM Q WHERE matrix_id NOT IN ('BUILDING', 'MACHINERY') GROUP BY ALL),
    R AS (SELECT unnest(generate_series(0, 19)) AS replicate),
    V AS (SELECT replicate, i, CASE WHEN replicate = 0 THEN i ELSE (i * 7 + replicate) % 25 END AS t FROM R, (SELECT unnest(generate_series(0, 24)) AS i)),
    C AS (SELECT a.replicate, corr(X.value, Y.value) AS r FROM X JOIN V a ON X.i = a.i JOIN V b ON X.j = b.i AND a.replicate = b.replicate JOIN Y ON Y.i = a.t AND Y.j = b.t WHERE a.t < b.t GROUP BY a.replicate)
    SELECT round(o.r, 6) + 0.0 AS stat, round((count(*) FILTER (WHERE abs(s.r) >= abs(o.r) - 1e-12) + 1) / 20.0::DOUBLE, 6) + 0.0 AS p FROM C o JOIN C s ON o.replicate = 0 AND s.replicate > 0 GROUP BY o.r""",
)
def permutation_matrix(spark, d):
    q = full_square(flows(spark, d))
    some = F.col("matrix_id").isin("BUILDING", "MACHINERY")
    x, y = (q.filter(w).groupBy("i", "j").agg(F.sum("value").alias("value")) for w in (some, ~some))
    moves = spark.range(25).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("replicate"))
    moves = moves.withColumn("to", F.when(F.col("replicate") == 0, F.col("i")).otherwise((F.col("i") * 7 + F.col("replicate")) % 25))
    return rounded(op.matrix_permutation(x, y, moves), "stat", "p")


@query("bootstrap_mean")
def bootstrap_mean(spark, d):
    return op.bootstrap(images(spark, d), 500)


_ISC = f"""{LONG}, T AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t FROM embeddings),
Z AS (SELECT label AS subject, t, voxel_id, value FROM L JOIN T ON image_id = vec_id WHERE t < 30 AND voxel_id < 16)"""
_ISC_ALL = _ISC.replace(" WHERE t < 30 AND voxel_id < 16", "")
_LOO = """, O AS (SELECT *, (sum(value) OVER (PARTITION BY t, voxel_id) - value) / (count(*) OVER (PARTITION BY t, voxel_id) - 1) AS others FROM Z),
R AS (SELECT subject, voxel_id, corr(value, others) AS r FROM O GROUP BY ALL)"""
#: At the last times only one subject has images.
_LOO_ALL = _LOO.replace("(count(*) OVER (PARTITION BY t, voxel_id) - 1)", "nullif(count(*) OVER (PARTITION BY t, voxel_id) - 1, 0)")
_PAIRS = ", R AS (SELECT x.subject AS a, y.subject AS b, x.voxel_id, corr(x.value, y.value) AS r FROM Z x JOIN Z y ON x.t = y.t AND x.voxel_id = y.voxel_id AND x.subject < y.subject GROUP BY ALL)"


def subjects(spark, d):
    """A label is a subject, the order of its images time, the first 16 voxels the regions; a fixed part of
    the table, as the SQL beside the queries without _all has it."""
    s = all_subjects(spark, d)
    return s.filter("t < 30 AND voxel_id < 16")


def subject_images(spark, d):
    """A label is a subject, the order of its images time: subject, t, values."""
    t = F.row_number().over(Window.partitionBy("label").orderBy("image_id")) - 1
    return images(spark, d).select(F.col("label").alias("subject"), t.cast("long").alias("t"), "values")


def all_subjects(spark, d):
    """All voxels at all times of each subject; a subject of fewer images lacks the last times."""
    i = subject_images(spark, d).select("subject", "t", F.posexplode("values").alias("voxel_id", "value"))
    return i.withColumn("voxel_id", F.col("voxel_id").cast("long"))


def shared_subjects(spark, d):
    """All voxels at the times that all subjects have, for maps that need equal numbers of samples."""
    least = images(spark, d).groupBy("label").count().agg(F.min("count").alias("shared"))
    return all_subjects(spark, d).join(F.broadcast(least), F.col("t") < F.col("shared")).drop("shared")


@query("isc_leave_one_out", f"WITH {_ISC}{_LOO} SELECT subject, voxel_id, round(r, 6) + 0.0 AS r FROM R")
def isc_leave_one_out(spark, d):
    return rounded(op.isc_leave_one_out(subjects(spark, d)), "r")


@query("isc_leave_one_out_all", f"WITH {_ISC_ALL}{_LOO_ALL} SELECT subject, voxel_id, round(r, 6) + 0.0 AS r FROM R")
def isc_leave_one_out_all(spark, d):
    return rounded(op.isc_leave_one_out(all_subjects(spark, d)), "r")


@query("isc_pairwise", f"WITH {_ISC}{_PAIRS} SELECT a, b, voxel_id, round(r, 6) + 0.0 AS r FROM R")
def isc_pairwise(spark, d):
    return rounded(op.isc_pairwise(subjects(spark, d)), "r")


@query("isc_pairwise_all", f"WITH {_ISC_ALL}{_PAIRS} SELECT a, b, voxel_id, round(r, 6) + 0.0 AS r FROM R")
def isc_pairwise_all(spark, d):
    return rounded(op.isc_pairwise(all_subjects(spark, d)), "r")


for _how, _sql in (("median", "quantile_cont(r, 0.5)"), ("mean", "tanh(avg(atanh(greatest(least(r, 0.999), -0.999))))")):
    for _kind, _cte, _all, _fn in (("loo", _LOO, _LOO_ALL, op.isc_leave_one_out), ("pairs", _PAIRS, _PAIRS, op.isc_pairwise)):
        query(f"isc_{_kind}_{_how}", f"WITH {_ISC}{_cte} SELECT voxel_id, round({_sql}, 6) + 0.0 AS isc FROM R GROUP BY voxel_id")(
            lambda spark, d, h=_how, f=_fn: rounded(op.summarize_isc(f(subjects(spark, d)), h), "isc")
        )
        query(f"isc_{_kind}_{_how}_all", f"WITH {_ISC_ALL}{_all} SELECT voxel_id, round({_sql}, 6) + 0.0 AS isc FROM R GROUP BY voxel_id")(
            lambda spark, d, h=_how, f=_fn: rounded(op.summarize_isc(f(all_subjects(spark, d)), h), "isc")
        )


@query("isc_bootstrap")
def isc_bootstrap(spark, d):
    return op.isc_bootstrap(op.isc_leave_one_out(all_subjects(spark, d)), 999)


@query("isc_group_difference")
def isc_group_difference(spark, d):
    return op.isc_group_difference(op.isc_leave_one_out(all_subjects(spark, d)), F.col("subject") < 5, 499)


@query(
    "isfc",
    f"""WITH {_ISC}, O AS (SELECT *, (sum(value) OVER (PARTITION BY t, voxel_id) - value) / (count(*) OVER (PARTITION BY t, voxel_id) - 1) AS others FROM Z WHERE voxel_id < 8)
    SELECT a.subject, a.voxel_id AS i, b.voxel_id AS j, round(corr(a.value, b.others), 6) + 0.0 AS r FROM O a JOIN O b ON a.subject = b.subject AND a.t = b.t GROUP BY ALL""",
)
def isfc(spark, d):
    return rounded(op.isfc(subjects(spark, d).filter("voxel_id < 8")), "r")


@query(
    "isfc_all",
    f"""WITH {_ISC_ALL}, O AS (SELECT *, (sum(value) OVER (PARTITION BY t, voxel_id) - value) / nullif(count(*) OVER (PARTITION BY t, voxel_id) - 1, 0) AS others FROM Z)
    SELECT a.subject, a.voxel_id AS i, b.voxel_id AS j, round(corr(a.value, b.others), 6) + 0.0 AS r FROM O a JOIN O b ON a.subject = b.subject AND a.t = b.t GROUP BY ALL""",
)
def isfc_all(spark, d):
    return rounded(op.isfc(all_subjects(spark, d)), "r")
