"""Queries of similarities, distances and matrices, over embeddings and the flows between nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import r6
from tessera.operators import matrices as op
from tessera.operators import pairs
from tessera.operators.pairs import image_pairs
from tessera.plans.image_queries import LONG
from tessera.plans.registry import query
from tessera.sources.tables import explode_images, images, table



def few(spark, d):
    """At most 80 images, as the SQL beside the queries without _all has it."""
    return images(spark, d).filter("image_id % 25 = 0 AND image_id < 2000").select("image_id", "values", "label")


def every(spark, d):
    return images(spark, d).select("image_id", "values", "label")


_PAIR = f"""WITH {LONG}, W AS (SELECT * FROM L WHERE image_id % 25 = 0 AND image_id < 2000) SELECT a.image_id AS i, b.image_id AS j, round({{}}, 6) + 0.0 AS value
FROM W a JOIN W b ON a.voxel_id = b.voxel_id AND a.image_id < b.image_id GROUP BY ALL"""
_PAIR_ALL = f"""WITH {LONG} SELECT a.image_id AS i, b.image_id AS j, round({{}}, 6) + 0.0 AS value
FROM L a JOIN L b ON a.voxel_id = b.voxel_id AND a.image_id < b.image_id GROUP BY ALL"""
_SIM = {
    "dot": "sum(a.value * b.value)",
    "cosine": "sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value))",
    "correlation": "corr(a.value, b.value)",
}
_DIST = {
    "euclidean": "sqrt(sum((a.value - b.value) ** 2))",
    "cityblock": "sum(abs(a.value - b.value))",
    "chebyshev": "max(abs(a.value - b.value))",
    "cosine": "1 - " + _SIM["cosine"],
    "correlation": "1 - corr(a.value, b.value)",
}


for _how, _sql in _SIM.items():
    query(f"similarity_{_how}", _PAIR.format(_sql))(lambda spark, d, h=_how: image_pairs(few(spark, d), pairs.SIMILARITIES[h]))
    query(f"similarity_{_how}_all", _PAIR_ALL.format(_sql))(lambda spark, d, h=_how: image_pairs(every(spark, d), pairs.SIMILARITIES[h]))
for _how, _sql in _DIST.items():
    query(f"distance_{_how}", _PAIR.format(_sql))(lambda spark, d, h=_how: image_pairs(few(spark, d), pairs.DISTANCES[h]))
    query(f"distance_{_how}_all", _PAIR_ALL.format(_sql))(lambda spark, d, h=_how: image_pairs(every(spark, d), pairs.DISTANCES[h]))


@query(
    "similarity_spearman",
    f"""WITH {LONG}, W AS (SELECT image_id, voxel_id, rank() OVER (PARTITION BY image_id ORDER BY value) + (count(*) OVER (PARTITION BY image_id, value) - 1) / 2 AS value
    FROM L WHERE image_id % 25 = 0 AND image_id < 2000) SELECT a.image_id AS i, b.image_id AS j, round(corr(a.value, b.value), 6) + 0.0 AS value
    FROM W a JOIN W b ON a.voxel_id = b.voxel_id AND a.image_id < b.image_id GROUP BY ALL""",
)
def similarity_spearman(spark, d):
    return image_pairs(op.spearman_vectors(few(spark, d)), pairs.correlations)


@query(
    "similarity_spearman_all",
    f"""WITH {LONG}, W AS (SELECT image_id, voxel_id, rank() OVER (PARTITION BY image_id ORDER BY value) + (count(*) OVER (PARTITION BY image_id, value) - 1) / 2 AS value FROM L)
    SELECT a.image_id AS i, b.image_id AS j, round(corr(a.value, b.value), 6) + 0.0 AS value FROM W a JOIN W b ON a.voxel_id = b.voxel_id AND a.image_id < b.image_id GROUP BY ALL""",
)
def similarity_spearman_all(spark, d):
    return image_pairs(op.spearman_vectors(every(spark, d)), pairs.correlations)


@query(
    "similarity_to_templates",
    f"""WITH {LONG}, M AS (SELECT label, voxel_id, avg(value) AS value FROM L GROUP BY ALL)
    SELECT L.image_id, M.label AS template, round(corr(L.value, M.value), 6) + 0.0 AS value FROM L JOIN M ON L.voxel_id = M.voxel_id GROUP BY ALL""",
)
def similarity_to_templates(spark, d):
    from tessera.operators.images import reduce_images
    from tessera.sources.tables import collect_images

    i = images(spark, d)
    templates = collect_images(reduce_images(i, "mean", "label"), "label").withColumnRenamed("label", "image_id")
    made = op.pair_images(i.select("image_id", "values"), templates, False)
    return made.select(F.col("image_id_i").alias("image_id"), F.col("image_id_j").alias("template"), r6(op.similarity("correlation")).alias("value"))


@query(
    "distance_by_roi",
    f"""WITH {LONG}, W AS (SELECT * FROM L WHERE image_id % 25 = 0 AND image_id < 2000) SELECT a.voxel_id // 8 AS roi, a.image_id AS i, b.image_id AS j,
    round(sqrt(sum((a.value - b.value) ** 2)), 6) + 0.0 AS value FROM W a JOIN W b ON a.voxel_id = b.voxel_id AND a.image_id < b.image_id GROUP BY ALL""",
)
def distance_by_roi(spark, d):
    return roi_distances(few(spark, d))


def roi_distances(frame):
    return image_pairs(frame, pairs.regional_euclidean(8), region="roi")


@query(
    "distance_by_roi_all",
    f"""WITH {LONG} SELECT a.voxel_id // 8 AS roi, a.image_id AS i, b.image_id AS j,
    round(sqrt(sum((a.value - b.value) ** 2)), 6) + 0.0 AS value FROM L a JOIN L b ON a.voxel_id = b.voxel_id AND a.image_id < b.image_id GROUP BY ALL""",
)
def distance_by_roi_all(spark, d):
    return roi_distances(every(spark, d))


@query(
    "column_correlations",
    f"""WITH {LONG}, W AS (SELECT * FROM L WHERE voxel_id < 16) SELECT a.voxel_id AS i, b.voxel_id AS j, round(corr(a.value, b.value), 6) + 0.0 AS r
    FROM W a JOIN W b ON a.image_id = b.image_id AND a.voxel_id < b.voxel_id GROUP BY ALL""",
)
def column_correlations(spark, d):
    first = images(spark, d).select(F.slice("values", 1, 16).alias("values"))
    return op.column_correlations(first).withColumn("r", r6(F.col("r")))


@query(
    "column_correlations_all",
    f"""WITH {LONG} SELECT a.voxel_id AS i, b.voxel_id AS j, round(corr(a.value, b.value), 6) + 0.0 AS r
    FROM L a JOIN L b ON a.image_id = b.image_id AND a.voxel_id < b.voxel_id GROUP BY ALL""",
)
def column_correlations_all(spark, d):
    return op.column_correlations(images(spark, d)).withColumn("r", r6(F.col("r")))


# a matrix for each market segment: orders' value from customer to supplier nation

ADJ = """A AS (SELECT c_mktsegment AS matrix_id, least(c_nationkey, s_nationkey) AS i, greatest(c_nationkey, s_nationkey) AS j, sum(l_quantity) / 100 AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
SQ AS (SELECT matrix_id, i, j, value FROM A UNION ALL SELECT matrix_id, j, i, value FROM A),
N AS (SELECT DISTINCT matrix_id, i FROM SQ), Q AS (SELECT * FROM SQ UNION ALL SELECT matrix_id, i, i, 0 FROM N)"""


def flows(spark, d):
    li, o, c, s = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.filter("c_nationkey <> s_nationkey")
    return j.groupBy(
        F.col("c_mktsegment").alias("matrix_id"), F.least("c_nationkey", "s_nationkey").alias("i"), F.greatest("c_nationkey", "s_nationkey").alias("j")
    ).agg((F.sum("l_quantity") / 100).alias("value"))


def node_labels(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("label"))


def rounded(frame, *columns):
    return frame.withColumns({c: r6(F.col(c)) for c in columns})


def edges(name, change, value, source="A", more=""):
    query(name, f"WITH {ADJ}{more} SELECT matrix_id, i, j, round({value}, 6) + 0.0 AS value FROM {source}")(
        lambda spark, d: rounded(change(flows(spark, d)), "value")
    )


edges("matrix_edges", lambda a: a, "value")
edges("matrix_square", op.full_square, "value", "Q")
edges("matrix_threshold_upper", lambda a: op.threshold_edges(a, upper=1.5), "CASE WHEN value < 1.5 THEN 0 ELSE value END")
edges("matrix_threshold_band", lambda a: op.threshold_edges(a, 0.5, 1.5), "CASE WHEN value > 0.5 AND value < 1.5 THEN 0 ELSE value END")
edges("matrix_threshold_binarize", lambda a: op.threshold_edges(a, upper=1.5, binarize=True), "CASE WHEN value >= 1.5 THEN 1.0 ELSE 0.0 END")
edges("matrix_to_similarity", op.to_similarity, "1 - value")
edges(
    "matrix_to_similarity_exp",
    lambda a: op.to_similarity(a, "euclidean", 0.5),
    "exp(-0.5 * value / s)",
    "A JOIN Z USING (matrix_id)",
    ", Z AS (SELECT matrix_id, stddev_pop(value) AS s FROM Q GROUP BY matrix_id)",
)
_MARGIN = """, M AS (SELECT q.*, sum(value) OVER (PARTITION BY matrix_id, i) AS r, sum(value) OVER (PARTITION BY matrix_id, j) AS c, sum(value) OVER (PARTITION BY matrix_id) AS g,
n FROM Q q JOIN (SELECT matrix_id, count(*) AS n FROM N GROUP BY 1) USING (matrix_id))"""
edges("matrix_double_center", lambda a: op.double_center(op.full_square(a)), "value - r / n - c / n + g / (n * n)", "M", _MARGIN)
edges(
    "matrix_u_center",
    lambda a: op.u_center(op.full_square(a)),
    "CASE WHEN i = j THEN 0 ELSE value - r / (n - 2) - c / (n - 2) + g / ((n - 1) * (n - 2)) END",
    "M WHERE n > 2",
    _MARGIN,
)
_AGG = {"mean": "avg(value)", "median": "quantile_cont(value, 0.5)", "std": "stddev_pop(value)", "sum": "sum(value)"}
for _how, _sql in _AGG.items():
    query(f"matrix_{_how}_over_matrices", f"WITH {ADJ} SELECT i, j, round({_sql}, 6) + 0.0 AS value FROM A GROUP BY ALL")(
        lambda spark, d, h=_how: rounded(op.reduce_matrices(flows(spark, d), h, 0), "value")
    )
    query(f"matrix_{_how}_over_edges", f"WITH {ADJ} SELECT matrix_id, round({_sql}, 6) + 0.0 AS value FROM A GROUP BY ALL")(
        lambda spark, d, h=_how: rounded(op.reduce_matrices(flows(spark, d), h, 1), "value")
    )


@query("matrix_permute", f"WITH {ADJ} SELECT matrix_id, CAST((i * 7 + 3) % 25 AS INTEGER) AS i, CAST((j * 7 + 3) % 25 AS INTEGER) AS j, round(value, 6) + 0.0 AS value FROM Q")
def matrix_permute(spark, d):
    moved = spark.range(25).select(F.col("id").cast("int").alias("i"), ((F.col("id") * 7 + 3) % 25).cast("int").alias("to"))
    return rounded(op.permute_nodes(op.full_square(flows(spark, d)), moved), "value")


_LABEL = ", B AS (SELECT A.*, na.n_regionkey AS li, nb.n_regionkey AS lj FROM A JOIN nation na ON na.n_nationkey = i JOIN nation nb ON nb.n_nationkey = j)"


@query(
    "matrix_label_distances",
    f"""WITH {ADJ}{_LABEL} SELECT label, within, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM (
    SELECT li AS label, true AS within, value FROM B WHERE li = lj UNION ALL SELECT li, false, value FROM B WHERE li <> lj UNION ALL SELECT lj, false, value FROM B WHERE li <> lj) GROUP BY ALL""",
)
def matrix_label_distances(spark, d):
    return rounded(op.label_distances(flows(spark, d), node_labels(spark, d)), "mean")


@query("matrix_label_pairs", f"WITH {ADJ}{_LABEL} SELECT least(li, lj) AS la, greatest(li, lj) AS lb, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM B GROUP BY ALL")
def matrix_label_pairs(spark, d):
    return rounded(op.label_pair_means(flows(spark, d), node_labels(spark, d)), "mean")


@query(
    "matrix_silhouette",
    f"""WITH {ADJ}{_LABEL}, E AS (SELECT i AS node, li AS label, li = lj AS same, value FROM B UNION ALL SELECT j, lj, li = lj, value FROM B),
    M AS (SELECT node, label, avg(value) FILTER (WHERE same) AS a, avg(value) FILTER (WHERE NOT same) AS b FROM E GROUP BY ALL)
    SELECT node AS i, label, round(CASE WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) + 0.0 AS s FROM M""",
)
def matrix_silhouette(spark, d):
    return rounded(op.silhouette(flows(spark, d), node_labels(spark, d)), "s")


@query(
    "matrix_edge_ttest",
    f"WITH {ADJ} SELECT i, j, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(coalesce(avg(value) / nullif(stddev_samp(value) / sqrt(count(*)), 0), 0), 6) + 0.0 AS t FROM A GROUP BY ALL",
)
def matrix_edge_ttest(spark, d):
    return rounded(op.edge_ttest(flows(spark, d)), "mean", "t")


@query(
    "matrix_distance_correlation",
    f"""WITH {ADJ}{_MARGIN}, C AS (SELECT matrix_id, i, j, value - r / n - c / n + g / (n * n) AS x FROM M),
    Q2 AS (SELECT matrix_id, i, j, CASE WHEN i = j THEN 0 ELSE sqrt(value) END AS value FROM Q),
    M2 AS (SELECT q.*, sum(value) OVER (PARTITION BY matrix_id, i) AS r, sum(value) OVER (PARTITION BY matrix_id, j) AS c, sum(value) OVER (PARTITION BY matrix_id) AS g, n
    FROM Q2 q JOIN (SELECT matrix_id, count(*) AS n FROM N GROUP BY 1) USING (matrix_id)), C2 AS (SELECT matrix_id, i, j, value - r / n - c / n + g / (n * n) AS y FROM M2)
    SELECT matrix_id, round(sqrt(greatest(avg(x * y) / sqrt(avg(x * x) * avg(y * y)), 0)), 6) + 0.0 AS dcor FROM C JOIN C2 USING (matrix_id, i, j) GROUP BY matrix_id""",
)
def matrix_distance_correlation(spark, d):
    q = op.full_square(flows(spark, d))
    return rounded(op.distance_correlation(q, q.withColumn("value", F.sqrt("value"))), "dcor")


@query("social_relations")
def social_relations(spark, d):
    li, o, c, s = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    square = j.groupBy(F.col("c_mktsegment").alias("matrix_id"), F.col("c_nationkey").alias("i"), F.col("s_nationkey").alias("j")).agg(F.avg("l_quantity").alias("value"))
    return op.social_relations(square)
