"""Queries of arithmetic, resampling tests and round robins of matrices: flows between nations, a matrix a month or a segment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import adjacency as op
from tessera.plans.inference_queries import plain_signs
from tessera.plans.matrix_queries import ADJ, flows, rounded
from tessera.plans.registry import query
from tessera.plans.resampling_queries import N, plain_weights
from tessera.sources.tables import table

_JOIN = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"

for _op, _sign in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):
    query(f"matrix_scalar_{_op}", f"WITH {ADJ} SELECT matrix_id, i, j, round(value {_sign} 2.5::DOUBLE, 6) + 0.0 AS value FROM A")(
        lambda spark, d, o=_op: rounded(op.arithmetic(flows(spark, d), o, 2.5), "value")
    )
    query(f"matrix_scalar_r{_op}", f"WITH {ADJ} SELECT matrix_id, i, j, round(2.5::DOUBLE {_sign} nullif(value, 0), 6) + 0.0 AS value FROM A")(
        lambda spark, d, o=_op: rounded(op.arithmetic(flows(spark, d), o, 2.5, reverse=True), "value")
    )
    query(
        f"matrix_pair_{_op}",
        f"""WITH {ADJ}, B AS (SELECT matrix_id, i, j, value * value + 1 AS other FROM A WHERE i % 3 < 2)
        SELECT matrix_id, i, j, round(value {_sign} other, 6) + 0.0 AS value FROM A FULL JOIN B USING (matrix_id, i, j)""",
    )(lambda spark, d, o=_op: rounded(op.arithmetic_matrices((a := flows(spark, d)), a.filter("i % 3 < 2").withColumn("value", F.col("value") * F.col("value") + 1), o), "value"))


MONTHS = f"""A AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS matrix_id, least(c_nationkey, s_nationkey) AS i, greatest(c_nationkey, s_nationkey) AS j,
sum(l_quantity) / 100 - 0.31830988618::DOUBLE AS value {_JOIN} WHERE c_nationkey <> s_nationkey GROUP BY ALL), R AS (SELECT unnest(generate_series(0, {N})) AS replicate)"""
_HASH = "(matrix_id * 7919 + replicate * (matrix_id % 31 + 1) * 104729) % 1000003"


def monthly_flows(spark, d):
    # the offset has eleven decimals, so that no mean of sums of cents is a tie of the digits compared
    li, o, c, s = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("matrix_id")
    ends = F.least("c_nationkey", "s_nationkey").alias("i"), F.greatest("c_nationkey", "s_nationkey").alias("j")
    return j.filter("c_nationkey <> s_nationkey").groupBy(month, *ends).agg((F.sum("l_quantity") / 100 - 0.31830988618).alias("value"))


for _tail, _sql in (("two", "abs(m) >= abs(own) - 1e-12"), ("upper", "m >= own - 1e-12"), ("lower", "m <= own + 1e-12")):
    query(
        f"matrix_edge_permutation_{_tail}",
        f"""WITH {MONTHS}, M AS (SELECT replicate, i, j, count(*) AS n, avg(value * CASE WHEN replicate = 0 THEN 1 ELSE 1 - 2 * ({_HASH} % 2) END) AS m FROM A, R GROUP BY ALL),
        O AS (SELECT i, j, n, m AS own FROM M WHERE replicate = 0)
        SELECT i, j, n, round(own, 6) + 0.0 AS stat, round((count(*) FILTER (WHERE {_sql}) + 1) / {N + 1}.0::DOUBLE, 6) + 0.0 AS p
        FROM (SELECT i, j, replicate, m FROM M WHERE replicate > 0) JOIN O USING (i, j) GROUP BY i, j, n, own""",
    )(lambda spark, d, t=_tail: rounded(op.edge_permutation(monthly_flows(spark, d), N, plain_signs, t), "stat", "p"))

_STAT = {
    "mean": "sum(w * value) / sum(w)",
    "sum": "sum(w * value)",
    "std": "sqrt(greatest(sum(w * value * value) / sum(w) - (sum(w * value) / sum(w)) ** 2, 0))",
    "min": "min(value)",
    "max": "max(value)",
}
for _how, _sql in _STAT.items():
    # digits of a deviation near 0 are lost in either engine: four are compared
    _d = 4 if _how == "std" else 6
    query(
        f"matrix_edge_bootstrap_{_how}",
        f"""WITH {MONTHS}, W AS (SELECT replicate, i, j, value, CASE WHEN replicate = 0 THEN 1 ELSE {_HASH} % 3 END AS w FROM A, R),
        S AS (SELECT replicate, i, j, {_sql} AS v FROM W WHERE w > 0 GROUP BY ALL)
        SELECT i, j, round(max(v) FILTER (WHERE replicate = 0), {_d}) + 0.0 AS stat, round(avg(v) FILTER (WHERE replicate > 0), {_d}) + 0.0 AS mean,
        round(quantile_cont(v, 0.025) FILTER (WHERE replicate > 0), {_d}) + 0.0 AS lo, round(quantile_cont(v, 0.975) FILTER (WHERE replicate > 0), {_d}) + 0.0 AS hi FROM S GROUP BY i, j""",
    )(
        lambda spark, d, h=_how, n=_d: op.edge_bootstrap(monthly_flows(spark, d), h, N, plain_weights).select(
            "i", "j", *[(F.round(c, n) + 0.0).alias(c) for c in ("stat", "mean", "lo", "hi")]
        )
    )


@query(
    "matrix_edge_bootstrap_median",
    f"""WITH {MONTHS}, W AS (SELECT replicate, i, j, value, CASE WHEN replicate = 0 THEN 1 ELSE {_HASH} % 3 END AS w FROM A, R),
    S AS (SELECT replicate, i, j, median(value) AS v FROM W JOIN (SELECT unnest([1, 2]) AS k) ON k <= w GROUP BY ALL)
    SELECT i, j, round(max(v) FILTER (WHERE replicate = 0), 6) + 0.0 AS stat, round(avg(v) FILTER (WHERE replicate > 0), 6) + 0.0 AS mean,
    round(quantile_cont(v, 0.025) FILTER (WHERE replicate > 0), 6) + 0.0 AS lo, round(quantile_cont(v, 0.975) FILTER (WHERE replicate > 0), 6) + 0.0 AS hi FROM S GROUP BY i, j""",
)
def matrix_edge_bootstrap_median(spark, d):
    return rounded(op.edge_bootstrap(monthly_flows(spark, d), "median", N, plain_weights), "stat", "mean", "lo", "hi").select("i", "j", "stat", "mean", "lo", "hi")


def round_robin(spark, d):
    li, o, c, s = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("c_mktsegment").alias("matrix_id"), F.col("c_nationkey").alias("i"), F.col("s_nationkey").alias("j")).agg(F.avg("l_quantity").alias("value"))


#: The round robin by sums over the filled square: person effects, their residuals, mean squares of dyads.
RELATIONS = f"""S AS (SELECT c_mktsegment AS matrix_id, c_nationkey AS i, s_nationkey AS j, avg(l_quantity)::DOUBLE AS value {_JOIN} WHERE c_nationkey <> s_nationkey GROUP BY ALL),
N AS (SELECT matrix_id, i FROM S UNION SELECT matrix_id, j FROM S),
RM AS (SELECT matrix_id, i, avg(value) AS rm FROM S GROUP BY ALL), CM AS (SELECT matrix_id, j, avg(value) AS cm FROM S GROUP BY ALL),
X AS (SELECT a.matrix_id, a.i, b.i AS j, coalesce(value, (coalesce(rm, 0) + coalesce(cm, 0)) / 2) AS x FROM N a JOIN N b ON a.matrix_id = b.matrix_id AND a.i <> b.i
LEFT JOIN S ON S.matrix_id = a.matrix_id AND S.i = a.i AND S.j = b.i LEFT JOIN RM ON RM.matrix_id = a.matrix_id AND RM.i = a.i LEFT JOIN CM ON CM.matrix_id = a.matrix_id AND CM.j = b.i),
G AS (SELECT matrix_id, avg(x) AS g, count(DISTINCT i)::DOUBLE AS n FROM X GROUP BY 1),
E AS (SELECT matrix_id, i, n, g, (n - 1) / (n * (n - 2)) * ((n - 1) * r + c - n * g) AS a, (n - 1) / (n * (n - 2)) * ((n - 1) * c + r - n * g) AS b
FROM (SELECT matrix_id, i, avg(x) AS r FROM X GROUP BY ALL) JOIN (SELECT matrix_id, j AS i, avg(x) AS c FROM X GROUP BY ALL) USING (matrix_id, i) JOIN G USING (matrix_id) WHERE n >= 4),
D AS (SELECT X.matrix_id, X.i, X.j, x - p.a - q.b - p.g AS e FROM X JOIN E p ON p.matrix_id = X.matrix_id AND p.i = X.i JOIN E q ON q.matrix_id = X.matrix_id AND q.i = X.j),
P AS (SELECT u.matrix_id, sum((u.e + v.e) ** 2) / 2 AS sp, sum((u.e - v.e) ** 2) / 2 AS sm FROM D u JOIN D v ON u.matrix_id = v.matrix_id AND u.i = v.j AND u.j = v.i AND u.i < u.j GROUP BY 1),
T AS (SELECT matrix_id, n, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM E GROUP BY ALL),
Y AS (SELECT matrix_id, n, aa, bb, ab, sp / ((n - 1) * (n - 2) / 2 - 1) AS mb, sm / ((n - 1) * (n - 2) / 2) AS mw FROM T JOIN P USING (matrix_id)),
V AS (SELECT matrix_id, n::BIGINT AS n, aa / (n - 1) - mb / (2 * (n - 2)) - mw / (2 * n) AS actor, bb / (n - 1) - mb / (2 * (n - 2)) - mw / (2 * n) AS partner, (mb + mw) / 2 AS relationship,
ab / (n - 1) - mb / (2 * (n - 2)) + mw / (2 * n) AS actor_partner, (mb - mw) / 2 AS dyad FROM Y),
K AS (SELECT *, actor + partner + relationship AS total, CASE WHEN actor * partner > 0 THEN actor_partner / sqrt(abs(actor * partner)) END AS actor_partner_r, dyad / nullif(relationship, 0) AS dyad_r,
actor / nullif(actor + relationship / (n - 1) - dyad / (n - 1) ** 2, 0) AS actor_reliability, partner / nullif(partner + relationship / (n - 1) - dyad / (n - 1) ** 2, 0) AS partner_reliability FROM V),
Z AS (SELECT *, CASE WHEN actor_reliability * partner_reliability >= 0 THEN actor_partner_r * sqrt(abs(actor_reliability * partner_reliability)) END AS adjusted_dyad_r FROM K)"""
_SHARES = ["actor", "partner", "relationship", "actor_partner", "dyad", "total", "actor_partner_r", "dyad_r", "actor_reliability", "partner_reliability", "adjusted_dyad_r"]


@query("relation_shares", f"WITH {RELATIONS} SELECT matrix_id, n, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _SHARES)} FROM Z")
def relation_shares(spark, d):
    return rounded(op.relation_shares(round_robin(spark, d)), *_SHARES).withColumn("n", F.col("n").cast("long"))


_EACH = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS component, {c} AS x, {y} AS y FROM Z"
    for c, y in [("actor", "actor / total"), ("partner", "partner / total"), ("relationship", "relationship / total"), ("actor_partner", "actor_partner_r"), ("dyad", "dyad_r")]
) + ")"


@query(
    "relation_summary",
    f"""WITH {RELATIONS} SELECT component, count(x) AS n, round(avg(x), 6) + 0.0 AS estimate, round(avg(y), 6) + 0.0 AS standardized, round(stddev_samp(x) / sqrt(count(x)), 6) + 0.0 AS se,
    round(avg(x) / (stddev_samp(x) / sqrt(count(x))), 6) + 0.0 AS t FROM ({_EACH}) GROUP BY component""",
)
def relation_summary(spark, d):
    made = op.summarize_relations(op.relation_shares(round_robin(spark, d)))  # p is held by tests/test_adjacency.py
    return rounded(made, "estimate", "standardized", "se", "t").drop("p")
