"""Queries of ranks, correlations, corrections, folds and ROC curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import r6
from tessera.operators import pairs
from tessera.operators import ranks as op
from tessera.plans.registry import query
from tessera.sources.tables import table

_R = "round({}, 6) + 0.0"


def lines(spark, d):
    return table(spark, d, "lineitem")


def _corr(x, y):
    return f"coalesce(CASE WHEN var_pop({x}) > 1e-9 AND var_pop({y}) > 1e-9 THEN corr({x}, {y}) ELSE 0 END, 0)"


@query("pearson_by_group", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_R.format(_corr('l_quantity', 'l_extendedprice'))} AS r FROM lineitem GROUP BY ALL")
def pearson_by_group(spark, d):
    return op.pearson(lines(spark, d), "l_quantity", "l_extendedprice", ["l_returnflag", "l_linestatus"]).withColumn("r", r6(F.col("r")))


_RANKS = """R AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS ry, l_orderkey, l_linenumber FROM lineitem)"""


@query("spearman_by_group", f"WITH {_RANKS} SELECT l_returnflag, count(*) AS n, {_R.format(_corr('rx', 'ry'))} AS r FROM R GROUP BY l_returnflag")
def spearman_by_group(spark, d):
    return op.spearman(lines(spark, d), "l_quantity", "l_discount", ["l_returnflag"]).withColumn("r", r6(F.col("r")))


@query("average_ranks", f"WITH {_RANKS} SELECT l_orderkey, l_linenumber, rx::DOUBLE AS rank FROM R")
def average_ranks(spark, d):
    return op.average_ranks(lines(spark, d), "l_quantity", ["l_returnflag"], "rank").select("l_orderkey", "l_linenumber", "rank")


@query(
    "kendall_by_group",
    """WITH O AS (SELECT o_custkey, o_orderkey, o_totalprice AS x, epoch(o_orderdate) AS y FROM orders)
    SELECT a.o_custkey, round(coalesce(sum(sign(a.x - b.x) * sign(a.y - b.y)) / nullif(sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))), 0), 0), 6) + 0.0 AS tau
    FROM O a JOIN O b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY a.o_custkey""",
)
def kendall_by_group(spark, d):
    o = table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_totalprice").alias("x"), F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("double").alias("y")
    )
    return op.kendall(o, "x", "y", ["o_custkey"]).withColumn("tau", r6(F.col("tau")))


_P = "P AS (SELECT o_orderpriority AS g, o_orderkey AS k, ((o_orderkey * 7919) % 10007 / 10007.0::DOUBLE) ** 3 AS p FROM orders)"


def pvalues(spark, d):
    p = F.pow((F.col("o_orderkey") * 7919) % 10007 / F.lit(10007.0), F.lit(3.0))
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("k"), p.alias("p"))


def _corrected(name, rule, spark_op):
    sql = f"""WITH {_P}, R AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p) AS i, count(*) OVER (PARTITION BY g) AS n FROM P)
    SELECT g, round(coalesce(max(p) FILTER (WHERE p <= {rule}), -1), 9) + 0.0 AS threshold FROM R GROUP BY g"""
    query(name, sql)(lambda spark, d: spark_op(pvalues(spark, d)).withColumn("threshold", F.round("threshold", 9) + F.lit(0.0)))


_corrected("fdr_threshold", "i * 0.05 / n", lambda f: op.fdr_threshold(f, "p", 0.05, ["g"]))
_corrected("holm_threshold", "0.05 / (n - i + 1)", lambda f: op.holm_threshold(f, "p", 0.05, ["g"]))


@query("folds_stratified", "SELECT vec_id, (row_number() OVER (PARTITION BY label ORDER BY embedding[1], vec_id) - 1) % 5 AS fold FROM embeddings")
def folds_stratified(spark, d):
    e = table(spark, d, "embeddings").withColumn("y", F.get("embedding", F.lit(0)))
    return op.stratified_folds(e, "y", "vec_id", 5, ["label"]).select("vec_id", "fold")


@query("folds_contiguous", "SELECT vec_id, ntile(5) OVER (PARTITION BY label ORDER BY vec_id) - 1 AS fold FROM embeddings")
def folds_contiguous(spark, d):
    return op.contiguous_folds(table(spark, d, "embeddings"), "vec_id", 5, ["label"]).select("vec_id", "fold")


@query("folds_by_group", "SELECT vec_id, dense_rank() OVER (ORDER BY label) - 1 AS fold FROM embeddings")
def folds_by_group(spark, d):
    return op.group_folds(table(spark, d, "embeddings"), "label").select("vec_id", "fold")


_ROC = """C AS (SELECT toxic, n_chars // 100 AS score, sum(quality)::BIGINT AS p, sum(1 - quality)::BIGINT AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
R AS (SELECT toxic, score, sum(p) OVER u / nullif(sum(p) OVER w, 0)::DOUBLE AS tpr, sum(n) OVER u / nullif(sum(n) OVER w, 0)::DOUBLE AS fpr FROM C
      WINDOW u AS (PARTITION BY toxic ORDER BY score DESC ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY toxic))"""


def roc(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return op.roc_points(both.select("toxic", "quality", F.floor(F.col("n_chars") / 100).alias("score")), "score", "quality", ["toxic"])


@query("roc_points", f"WITH {_ROC} SELECT toxic, score, round(tpr, 6) + 0.0 AS tpr, round(fpr, 6) + 0.0 AS fpr FROM R")
def roc_points(spark, d):
    return roc(spark, d).select("toxic", "score", r6(F.col("tpr")).alias("tpr"), r6(F.col("fpr")).alias("fpr"))


@query(
    "roc_auc",
    f"""WITH {_ROC} SELECT toxic, round(sum((fpr - bf) * (tpr + bt) / 2), 6) + 0.0 AS auc FROM
    (SELECT *, coalesce(lag(fpr) OVER v, 0) AS bf, coalesce(lag(tpr) OVER v, 0) AS bt FROM R WINDOW v AS (PARTITION BY toxic ORDER BY score DESC)) GROUP BY toxic""",
)
def roc_auc(spark, d):
    return op.auc(roc(spark, d), "score", ["toxic"]).withColumn("auc", r6(F.col("auc")))


for _how, _gain in (("balanced", "tpr - fpr"), ("sdt_bias", "-abs(tpr + fpr - 1)")):
    query(
        f"roc_threshold_{_how}",
        f"""WITH {_ROC} SELECT toxic, score AS threshold, round(tpr, 6) + 0.0 AS tpr, round(fpr, 6) + 0.0 AS fpr FROM
        (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY round({_gain}, 12) DESC, score DESC) AS i FROM R WHERE tpr IS NOT NULL AND fpr IS NOT NULL) WHERE i = 1""",
    )(
        lambda spark, d, h=_how: op.best_threshold(roc(spark, d).filter("tpr IS NOT NULL AND fpr IS NOT NULL"), "score", ["toxic"], h).select(
            "toxic", "threshold", r6(F.col("tpr")).alias("tpr"), r6(F.col("fpr")).alias("fpr")
        )
    )


_DIFFERENCES = """SELECT a.c_nationkey, a.c_custkey AS ka, b.c_custkey AS kb, round(a.c_acctbal - b.c_acctbal, 6) + 0.0 AS dx,
    CASE WHEN a.c_mktsegment > b.c_mktsegment THEN 1.0 ELSE -1.0 END::DOUBLE AS label
    FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND a.c_mktsegment <> b.c_mktsegment"""


@query("transform_pairs", _DIFFERENCES)
@query("transform_pairs_all", _DIFFERENCES)
def transform_pairs(spark, d):
    return customer_pairs(table(spark, d, "customer"))


def customer_pairs(c):
    code = sum((F.when(F.col("c_mktsegment") > s, 1).otherwise(0) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")), F.lit(0))
    return pairs.differences(c.withColumn("y", code), "c_acctbal", "y", "c_nationkey", "c_custkey", 6)


@query(
    "top_labels",
    """SELECT l_returnflag, p_brand, n, i FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, p_brand) AS i FROM
    (SELECT l_returnflag, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE i <= 5""",
)
def top_labels(spark, d):
    from pyspark.sql import Window

    named = lines(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = named.groupBy("l_returnflag", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    i = F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.desc("n"), "p_brand")).cast("long")
    return n.withColumn("i", i).filter("i <= 5")
