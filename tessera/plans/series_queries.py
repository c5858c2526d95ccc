"""Queries of the series and design operators over events, lineitem and embeddings."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import r6
from tessera.operators import confounds
from tessera.operators import series as op
from tessera.plans.registry import query
from tessera.sources.tables import daily_series, day_angle, table

S = """D AS (SELECT user_id AS subject, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS t, avg(value) AS value FROM events GROUP BY ALL),
S AS (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY t) - 1 AS row_id, value, count(*) OVER (PARTITION BY subject) AS n FROM D)"""
KERNEL = (0.5, 0.3, 0.15, 0.05)


def series(spark, d):
    """subject, row_id, value: daily means of each user's events."""
    return op.with_row_id(daily_series(spark, d), ["subject"], "t").select("subject", "row_id", "value")


def out(frame, digits=6):
    return frame.select("subject", F.col("row_id").cast("long"), (F.round("value", digits) + F.lit(0.0)).alias("value"))


def simple(name, change, body, digits=6):
    query(name, f"WITH {S} {body}")(lambda spark, d: out(change(series(spark, d)), digits))


def cell(value):
    return f"SELECT subject, row_id, round({value}, 6) + 0.0 AS value FROM S"


BY = ["subject"]
for _how, _agg in (("mean", "avg(value)"), ("median", "quantile_cont(value, 0.5)")):
    simple(
        f"series_downsample_{_how}",
        lambda s, h=_how: op.downsample(s, BY, 3, h),
        f"SELECT subject, CAST(row_id // 3 AS BIGINT) AS row_id, round({_agg}, 6) + 0.0 AS value FROM S GROUP BY ALL",
    )
for _how, _value in (
    ("linear", "value + (next - value) * (k / 4.0::DOUBLE)"),
    ("nearest", "CASE WHEN k * 2 <= 4 THEN value ELSE next END"),
):
    simple(
        f"series_upsample_{_how}",
        lambda s, h=_how: op.upsample(s, BY, 4, h),
        f"""SELECT subject, row_id * 4 + k AS row_id, round({_value}, 6) + 0.0 AS value
        FROM (SELECT *, lead(value) OVER (PARTITION BY subject ORDER BY row_id) AS next FROM S), (SELECT unnest([0, 1, 2, 3]) AS k) WHERE next IS NOT NULL""",
    )
# ten digits: means of a few values with six end in exact halves of the sixth
simple(
    "series_detrend_constant",
    lambda s: op.detrend(s, BY, "constant"),
    "SELECT subject, row_id, round(value - avg(value) OVER (PARTITION BY subject), 10) + 0.0 AS value FROM S",
    10,
)
simple(
    "series_detrend_linear",
    lambda s: op.detrend(s, BY),
    """, M AS (SELECT subject, avg(value) AS mv, avg(row_id) AS mt, covar_pop(value, row_id) AS c, var_pop(row_id) AS v FROM S GROUP BY subject)
    SELECT subject, row_id, round(value - mv - CASE WHEN v = 0 THEN 0 ELSE c / v END * (row_id - mt), 6) + 0.0 AS value FROM S JOIN M USING (subject)""",
)
simple(
    "series_circle_shift",
    lambda s: op.circle_shift(s, BY, F.col("subject") % 5 + 1),
    "SELECT subject, (row_id + subject % 5 + 1) % n AS row_id, round(value, 6) + 0.0 AS value FROM S",
)
simple(
    "series_convolve",
    lambda s: op.convolve(s, BY, KERNEL),
    "SELECT subject, row_id, round("
    + " + ".join(f"coalesce(lag(value, {k}) OVER (PARTITION BY subject ORDER BY row_id), 0) * {w}" for k, w in enumerate(KERNEL))
    + ", 6) + 0.0 AS value FROM S",
)


@query(
    "series_find_spikes",
    f"""WITH {S}, T AS (SELECT *, abs(lead(value) OVER (PARTITION BY subject ORDER BY row_id) - value) AS step FROM S),
    M AS (SELECT subject, avg(value) AS mv, stddev_pop(value) AS sv, avg(step) AS ms, stddev_pop(step) AS ss FROM T GROUP BY subject)
    SELECT subject, row_id, coalesce(value > mv + 1.5 * sv OR value < mv - 1.5 * sv, false) AS global_spike,
           coalesce(step > ms + 1.5 * ss OR step < ms - 1.5 * ss, false) AS diff_spike FROM T JOIN M USING (subject)""",
)
def series_find_spikes(spark, d):
    return op.find_spikes(series(spark, d), BY, 1.5)


@query(
    "series_censor",
    f"""WITH {S}, B AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY subject ORDER BY row_id)) > 40, false) AS bad FROM S),
    G AS (SELECT *, sum(bad::INT) OVER (PARTITION BY subject ORDER BY row_id) AS g FROM B),
    K AS (SELECT *, NOT bad AND count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY subject, g) >= 3 AS kept FROM G)
    SELECT subject, row_id, kept, round(value - avg(value) FILTER (WHERE kept) OVER (PARTITION BY subject), 9) + 0.0 AS value FROM K""",
)
def series_censor(spark, d):
    """Daily values as a confound whose steps are the displacement: days after a jump and short stretches go, the rest is demeaned.
    Nine digits, as means of a few cents are ties of the seventh."""
    s = series(spark, d)
    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("subject").orderBy("row_id")))
    named = F.create_map(F.lit("global_signal"), F.col("value"), F.lit(confounds.DISPLACEMENT), step)
    masked = confounds.sample_masks(s.select(F.col("subject").alias("path"), "row_id", named.alias("values")), 40.0, None, 3)
    made = confounds.select_confounds(masked, {"global_signal": "basic"})
    return made.select(F.col("path").alias("subject"), F.col("row_id").cast("long"), "kept", (F.round(F.col("values")["global_signal"], 9) + 0.0).alias("value"))


@query(
    "series_add_poly",
    f"""WITH {S}, X AS (SELECT *, CASE WHEN n > 1 THEN row_id * 2.0::DOUBLE / (n - 1) - 1 ELSE -1 END AS x FROM S)
    SELECT subject, row_id, round(x, 6) + 0.0 AS poly_1, round((3 * x * x - 1) / 2, 6) + 0.0 AS poly_2,
           round((5 * x * x * x - 3 * x) / 2, 6) + 0.0 AS poly_3 FROM X""",
)
def series_add_poly(spark, d):
    made = op.add_poly(series(spark, d), BY, 3)
    return made.select("subject", "row_id", *[r6(F.col(f"poly_{k}")).alias(f"poly_{k}") for k in (1, 2, 3)])


@query(
    "series_add_cosines",
    f"WITH {S} SELECT subject, row_id, "
    + ", ".join(f"round(cos({math.pi} * (2 * row_id + 1) * {i} / (2 * n)) / cos({math.pi} / (2 * n)), 6) + 0.0 AS cosine_{i}" for i in (1, 2, 3))
    + " FROM S WHERE n > 2",
)
def series_add_cosines(spark, d):
    s = series(spark, d)
    long = s.join(s.groupBy("subject").count().filter("count > 2").drop("count"), "subject")
    return op.add_cosines(long, BY, 3).select("subject", "row_id", *[r6(F.col(f"cosine_{k}")).alias(f"cosine_{k}") for k in (1, 2, 3)])


@query(
    "design_boxcar",
    """WITH E AS (SELECT event_type AS kind, (event_id % 2000)::DOUBLE AS onset, 1 + event_id % 3 AS duration FROM events),
    R AS (SELECT unnest(generate_series(0, 999)) AS row_id)
    SELECT R.row_id, """
    + ", ".join(f"count(*) FILTER (WHERE kind = '{k}')::DOUBLE AS {k}" for k in ("click", "view", "purchase"))
    + " FROM R LEFT JOIN E ON onset <= R.row_id / 0.5 AND R.row_id / 0.5 < onset + duration GROUP BY R.row_id",
)
def design_boxcar(spark, d):
    ev = table(spark, d, "events").select(
        F.col("event_type").alias("kind"), (F.col("event_id") % 2000).cast("double").alias("onset"), (1 + F.col("event_id") % 3).alias("duration")
    )
    return op.boxcar(ev, 1000, 0.5, ["click", "view", "purchase"])


@query(
    "phase_summary",
    """SELECT user_id, count(*) AS n, round(atan2(avg(sin(a)), avg(cos(a))), 6) + 0.0 AS mean_angle,
    round(sqrt(avg(sin(a)) ** 2 + avg(cos(a)) ** 2), 6) + 0.0 AS vector_length FROM
    (SELECT user_id, epoch_us(ts) % 86400000000 / 86400000000.0::DOUBLE * 6.283185307179586 AS a FROM events) GROUP BY user_id""",
)
def phase_summary(spark, d):
    ev = table(spark, d, "events").withColumn("a", day_angle())
    return op.phase_summary(ev, ["user_id"], "a").select("user_id", "n", r6(F.col("mean_angle")).alias("mean_angle"), r6(F.col("vector_length")).alias("vector_length"))


@query("phase_rayleigh_p")
def phase_rayleigh_p(spark, d):
    ev = table(spark, d, "events").withColumn("a", day_angle())
    return op.phase_summary(ev, ["user_id"], "a")


# design columns over lineitem

KEYS = "l_orderkey, l_linenumber"


def lines(spark, d):
    return table(spark, d, "lineitem")


def column(name, change, value, more="", source="lineitem"):
    body = f"{more} SELECT {KEYS}, round({value}, 6) + 0.0 AS value FROM {source}"
    query(name, body)(
        lambda spark, d: change(lines(spark, d)).select("l_orderkey", "l_linenumber", r6(F.col("l_extendedprice")).alias("value"))
    )


_BY_FLAG = ["l_returnflag"]
_OVER = "OVER (PARTITION BY l_returnflag)"
column(
    "design_zscore",
    lambda f: op.zscore(f, ["l_extendedprice"], _BY_FLAG),
    f"(l_extendedprice - avg(l_extendedprice) {_OVER}) / stddev_samp(l_extendedprice) {_OVER}",
)
column("design_center", lambda f: op.zscore(f, ["l_extendedprice"], _BY_FLAG, True), f"l_extendedprice - avg(l_extendedprice) {_OVER}")
_QUANT = "WITH B AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem GROUP BY 1)"
_STD = "WITH B AS (SELECT l_returnflag, avg(l_extendedprice) - 1.5 * stddev_samp(l_extendedprice) AS lo, avg(l_extendedprice) + 1.5 * stddev_samp(l_extendedprice) AS hi FROM lineitem GROUP BY 1)"
_JOIN = "lineitem JOIN B USING (l_returnflag)"
_CLIP = "CASE WHEN l_extendedprice < lo THEN lo WHEN l_extendedprice > hi THEN hi ELSE l_extendedprice END"
column("winsorize_quantile", lambda f: op.winsorize(f, "l_extendedprice", _BY_FLAG), _CLIP, _QUANT, _JOIN)
column("winsorize_std", lambda f: op.winsorize(f, "l_extendedprice", _BY_FLAG, "std", 1.5, 1.5), _CLIP, _STD, _JOIN)
column(
    "winsorize_nearest",
    lambda f: op.winsorize(f, "l_extendedprice", _BY_FLAG, to_cutoff=False),
    "CASE WHEN l_extendedprice < lo THEN li WHEN l_extendedprice > hi THEN hn ELSE l_extendedprice END",
    _QUANT + ", I AS (SELECT l_returnflag, min(l_extendedprice) AS li, max(l_extendedprice) AS hn FROM lineitem JOIN B USING (l_returnflag) WHERE l_extendedprice > lo AND l_extendedprice < hi GROUP BY 1)",
    _JOIN + " JOIN I USING (l_returnflag)",
)
column(
    "trim_std", lambda f: op.trim(f, "l_extendedprice", _BY_FLAG, "std", 1.5, 1.5), "CASE WHEN l_extendedprice BETWEEN lo AND hi THEN l_extendedprice END", _STD, _JOIN
)
column(
    "trim_quantile",
    lambda f: op.trim(f, "l_extendedprice", _BY_FLAG, "quantile", 0.05, 0.95),
    "CASE WHEN l_extendedprice BETWEEN lo AND hi THEN l_extendedprice END",
    _QUANT,
    _JOIN,
)
column(
    "design_fill_missing",
    lambda f: op.fill_missing(f.withColumn("l_extendedprice", F.when(F.col("l_linenumber") == 2, None).when(F.col("l_linenumber") == 3, F.lit("NaN").cast("double")).otherwise(F.col("l_extendedprice"))), ["l_extendedprice"], -1.0),
    "CASE WHEN l_linenumber IN (2, 3) THEN -1 ELSE l_extendedprice END",
)


@query("design_row_sum", f"SELECT {KEYS}, round(l_quantity + l_discount + l_tax, 6) + 0.0 AS value FROM lineitem")
def design_row_sum(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", r6(F.col("l_quantity") + F.col("l_discount") + F.col("l_tax")).alias("value"))


@query(
    "design_column_sums",
    "SELECT round(sum(l_quantity), 4) + 0.0 AS l_quantity, round(sum(l_discount), 4) + 0.0 AS l_discount, round(sum(l_tax), 4) + 0.0 AS l_tax FROM lineitem",
)
def design_column_sums(spark, d):
    return lines(spark, d).agg(*[(F.round(F.sum(c), 4) + 0.0).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])


def _run(spark, d, flag, extra=None):
    f = lines(spark, d).filter((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == flag))
    f = f.select(F.col("l_orderkey").alias("row_id"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("poly_0"))
    return f.withColumn(extra, F.col("q") * 2) if extra else f


@query(
    "design_append_horizontal",
    """SELECT row_id, coalesce(q, 0) AS q, coalesce(p, 0) AS p FROM
    (SELECT l_orderkey AS row_id, l_quantity AS q FROM lineitem WHERE l_linenumber = 1) FULL JOIN
    (SELECT l_orderkey AS row_id, l_extendedprice AS p FROM lineitem WHERE l_linenumber = 2) USING (row_id)""",
)
def design_append_horizontal(spark, d):
    a, b = (lines(spark, d).filter(F.col("l_linenumber") == k) for k in (1, 2))
    return op.append_horizontal(
        a.select(F.col("l_orderkey").alias("row_id"), F.col("l_quantity").alias("q")), b.select(F.col("l_orderkey").alias("row_id"), F.col("l_extendedprice").alias("p"))
    )


@query(
    "design_append_vertical",
    """SELECT 0 AS run, l_orderkey AS row_id, l_quantity AS q, l_tax AS poly_0, 0.0::DOUBLE AS r FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'A'
    UNION ALL SELECT 1, l_orderkey, l_quantity, l_tax, l_quantity * 2 FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R'""",
)
def design_append_vertical(spark, d):
    return op.append_vertical([_run(spark, d, "A"), _run(spark, d, "R", "r")])


@query(
    "design_append_separated",
    """SELECT 0 AS run, l_orderkey AS row_id, l_quantity AS q, l_tax AS "0_poly_0", 0.0::DOUBLE AS "1_poly_0" FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'A'
    UNION ALL SELECT 1, l_orderkey, l_quantity, 0, l_tax FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R'""",
)
def design_append_separated(spark, d):
    return op.append_vertical([_run(spark, d, "A"), _run(spark, d, "R")], ["poly_*"])


@query("mask_expand", "SELECT vec_id, m AS mask, CAST(label = m AS INTEGER) AS value FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS m)")
def mask_expand(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return op.expand_labels(e, "label", range(4)).select("vec_id", "mask", "value")


@query(
    "mask_collapse",
    """WITH M AS (SELECT vec_id AS mask_id, generate_subscripts(embedding, 1) - 1 AS voxel_id, CAST(unnest(embedding) > 0.02 AS INTEGER) AS value FROM embeddings)
    SELECT voxel_id, sum(mask_id + 1)::BIGINT AS label FROM M WHERE value <> 0 GROUP BY voxel_id HAVING count(*) < (SELECT count(DISTINCT mask_id) FROM M)""",
)
def mask_collapse(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("mask_id"), F.posexplode("embedding").alias("voxel_id", "x"))
    return op.collapse_masks(e.withColumn("value", (F.col("x") > 0.02).cast("int"))).select(F.col("voxel_id").cast("long"), "label")
