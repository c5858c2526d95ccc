"""Operators on stacks of matrices and on similarities between images.

adj(matrix_id, i, j, value): edges, i < j for symmetric matrices (the diagonal is implied), all (i, j)
otherwise. Reducers over edges ignore NaN, unlike those of images; null is skipped anyway.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import array_center, array_sum, dot, safe_div
from tessera.operators.sizes import sent
from tessera.operators.sums import sum_arrays, sum_arrays_by

#: Columns of a block of products, numbers of stacked rows, and of products kept by a task until its end.
COLUMNS, STACK, HELD = 256, 1 << 24, 1 << 22


def with_norms(frame: DataFrame) -> DataFrame:
    """images with the inner products that similarities need, so a pair costs one more."""
    v = F.col("values")
    return frame.withColumns({"norm2": dot(v, v), "sum": array_sum(v)})


#: Images in a block, about. A join key is a pair of blocks, so no task needs more than two of them at once.
BLOCK = 512


def block_count(frame: DataFrame) -> int:
    """Into how many blocks the images go; counts them."""
    return max(1, -(-frame.count() // BLOCK))


def _meet(left: DataFrame, right: DataFrame, blocks_i: int, blocks_j: int, by: Sequence[str] = ()) -> DataFrame:
    """Every pair of a row of left and one of right with equal `by`. Ids are hashed into blocks; each side goes
    once to each block of the other."""
    a = left.select("*", F.pmod(F.hash("image_id_i"), F.lit(blocks_i)).alias("block_i"), F.explode(F.sequence(F.lit(0), F.lit(blocks_j - 1))).alias("block_j"))
    b = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks_i - 1))).alias("block_i"), F.pmod(F.hash("image_id_j"), F.lit(blocks_j)).alias("block_j"))
    return a.join(b.hint("merge"), [*by, "block_i", "block_j"]).drop("block_i", "block_j")


def join_blocks(left: DataFrame, right: DataFrame, blocks: int, by: Sequence[str] = ()) -> DataFrame:
    """Every pair of a row of left (image_id_i, ...) and one of right (image_id_j, ...) with equal `by` and
    image_id_i < image_id_j, as a join of blocks."""
    return _meet(left, right, blocks, blocks, by).filter("image_id_i < image_id_j")


def pair_images(a: DataFrame, b: DataFrame, same: bool) -> DataFrame:
    """The pairs of two sets of images: both ends, their values and sums. With `same`, the pairs of one set
    with image_id_i < image_id_j; otherwise each of a with each of b, whose ids may be of another type. Both are
    joins of blocks, so either set may be a whole table; no set is sent to all tasks."""
    left = with_norms(a).select(*[F.col(c).alias(f"{c}_i") for c in ("image_id", "values", "norm2", "sum")])
    right = with_norms(b).select(*[F.col(c).alias(f"{c}_j") for c in ("image_id", "values", "norm2", "sum")])
    pairs = join_blocks(left, right, block_count(a)) if same else _meet(left, right, block_count(a), block_count(b))
    return pairs.withColumn("xy", dot(F.col("values_i"), F.col("values_j"))).withColumn("n", F.size("values_i"))


def similarity(how: str) -> Column:
    """dot, cosine or correlation of a pair from pair_images."""
    xy, ni, nj, n = F.col("xy"), F.col("norm2_i"), F.col("norm2_j"), F.col("n")
    if how == "dot":
        return xy
    if how == "cosine":
        return safe_div(xy, F.sqrt(ni * nj))
    vi, vj = ni - F.col("sum_i") * F.col("sum_i") / n, nj - F.col("sum_j") * F.col("sum_j") / n
    return safe_div(xy - F.col("sum_i") * F.col("sum_j") / n, F.sqrt(F.greatest(vi * vj, F.lit(0.0))))


def distance(how: str) -> Column:
    """euclidean, cityblock, chebyshev, cosine or correlation distance of a pair."""
    if how == "euclidean":
        return F.sqrt(F.greatest(F.col("norm2_i") + F.col("norm2_j") - 2 * F.col("xy"), F.lit(0.0)))
    gaps = F.zip_with("values_i", "values_j", lambda x, y: F.abs(x - y))
    if how == "cityblock":
        return array_sum(gaps)
    return F.array_max(gaps) if how == "chebyshev" else 1 - similarity(how)


def column_correlations(frame: DataFrame, values: str = "values") -> DataFrame:
    """i, j, r: correlations over rows of the elements i < j of a table of vectors of one length.

    Three passes without a row a pair: means, deviations, then products of standardised rows as matrix products, of which
    sums meet on the executors in pieces. A task holds STACK numbers of rows, and products of all pairs only up to HELD
    numbers. r is 0 where an element does not vary. Vectors of two lengths, null vectors and null or non-finite elements
    are errors; an empty table gives an empty one.
    """
    vectors = frame.select(values)

    def stacked(batch: pd.DataFrame) -> np.ndarray:
        return np.stack([np.asarray(v, float) for v in batch[values]])

    sums = sum_arrays(vectors, lambda batch: np.r_[len(batch), stacked(batch).sum(axis=0)])
    if sums is not None and not np.isfinite(sums).all():
        raise ValueError("vectors hold null or non-finite values")
    mean = np.zeros(0) if sums is None else sums[1:] / sums[0]
    width = len(mean)
    spread = None if sums is None else sum_arrays(vectors, lambda batch: ((stacked(batch) - mean) ** 2).sum(axis=0))
    scale = np.zeros(0) if spread is None else np.where(spread > 1e-12, 1 / np.sqrt(np.maximum(spread, 1e-300)), 0.0)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray]]:
        held: dict[int, np.ndarray] = {}
        waiting, rows = [], 0

        def due() -> Iterator[tuple[int, np.ndarray]]:
            z = np.concatenate(waiting)
            for a in range(0, width, COLUMNS):
                made = z[:, a : a + COLUMNS].T @ z[:, a:]
                if width * width > HELD:
                    yield a, made
                else:
                    held[a] = held[a] + made if a in held else made

        for batch in batches:
            if len(batch):
                waiting.append((stacked(batch) - mean) * scale)
                rows += len(batch)
            if rows * width > STACK:
                yield from due()
                waiting, rows = [], 0
        if waiting:
            yield from due()
        yield from held.items()

    summed = sum_arrays_by(vectors, "int", products, COLUMNS)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, at, flat in batch.itertuples(index=False):
                block = np.asarray(flat, float).reshape(min(COLUMNS, width - a), -1)
                i, j = np.arange(len(block))[:, None] + a, np.arange(block.shape[1])[None, :] + a + at
                p, q = np.nonzero(i < j)
                yield pd.DataFrame({"i": p + a, "j": q + a + at, "r": block[p, q]})

    return summed.mapInPandas(cells, "i long, j long, r double")


def threshold_edges(adj: DataFrame, lower: float | None = None, upper: float | None = None, binarize: bool = False) -> DataFrame:
    """Zero what lies below upper (alone), above lower (alone) or strictly between both."""
    x = F.col("value")
    if lower is not None and upper is not None:
        gone = (x > lower) & (x < upper)
    else:
        gone = x < upper if upper is not None else x > lower
    kept = F.when(gone, F.lit(0.0)).otherwise(x)
    return adj.withColumn("value", F.when(kept != 0, F.lit(1.0)).otherwise(F.lit(0.0)) if binarize else kept)


def reduce_matrices(adj: DataFrame, how: str, axis: int) -> DataFrame:
    """axis 0: over matrices for each edge; axis 1: over edges for each matrix. NaN is left out."""
    x = F.when(~F.isnan("value"), F.col("value"))
    agg = {"mean": F.avg(x), "median": F.percentile(x, 0.5), "std": F.stddev_pop(x), "sum": F.coalesce(F.sum(x), F.lit(0.0))}[how]
    return adj.groupBy(*(("i", "j") if axis == 0 else ("matrix_id",))).agg(agg.alias("value"))


def full_square(adj: DataFrame, diagonal: float = 0.0) -> DataFrame:
    """Both triangles and the diagonal of symmetric matrices."""
    flipped = adj.select("matrix_id", F.col("j").alias("i"), F.col("i").alias("j"), "value")
    nodes = adj.select("matrix_id", F.explode(F.array("i", "j")).alias("i")).distinct()
    return adj.select("matrix_id", "i", "j", "value").union(flipped).union(nodes.select("matrix_id", "i", F.col("i").alias("j"), F.lit(diagonal)))


def permute_nodes(square: DataFrame, moved: DataFrame) -> DataFrame:
    """P A P' with moved(i, to): only names change."""
    a, b = moved.select("i", F.col("to").alias("ti")), moved.select(F.col("i").alias("j"), F.col("to").alias("tj"))
    return square.join(sent(a), "i").join(sent(b), "j").select("matrix_id", F.col("ti").alias("i"), F.col("tj").alias("j"), "value")


def to_similarity(adj: DataFrame, how: str = "correlation", beta: float = 1.0) -> DataFrame:
    """1 - d; or exp(-beta d / s), s the deviation over the whole square, diagonal zeros included."""
    if how == "correlation":
        return adj.withColumn("value", 1 - F.col("value"))
    square = full_square(adj).groupBy("matrix_id").agg(F.stddev_pop("value").alias("s_"))
    return adj.join(square, "matrix_id").withColumn("value", F.exp(-beta * F.col("value") / F.col("s_"))).drop("s_")


def _margins(square: DataFrame) -> DataFrame:
    rows = square.groupBy("matrix_id", "i").agg(F.sum("value").alias("row_sum"))
    cols = square.groupBy("matrix_id", "j").agg(F.sum("value").alias("col_sum"))
    total = square.groupBy("matrix_id").agg(F.sum("value").alias("total"), F.countDistinct("i").alias("n"))
    return square.join(rows, ["matrix_id", "i"]).join(cols, ["matrix_id", "j"]).join(total, "matrix_id")


def double_center(square: DataFrame) -> DataFrame:
    """x less row and column means plus the grand mean."""
    n = F.col("n")
    value = F.col("value") - F.col("row_sum") / n - F.col("col_sum") / n + F.col("total") / (n * n)
    return _margins(square).select("matrix_id", "i", "j", value.alias("value"))


def u_center(square: DataFrame) -> DataFrame:
    """The bias-corrected centring, n > 2; the diagonal is 0."""
    n = F.col("n")
    value = F.col("value") - F.col("row_sum") / (n - 2) - F.col("col_sum") / (n - 2) + F.col("total") / ((n - 1) * (n - 2))
    made = F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(value)
    return _margins(square).filter("n > 2").select("matrix_id", "i", "j", made.alias("value"))


def distance_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """matrix_id, dcor of two stacks of square distance matrices (uncorrected)."""
    x = double_center(a)
    y = double_center(b).withColumnRenamed("value", "other")
    s = x.join(y, ["matrix_id", "i", "j"]).groupBy("matrix_id").agg(
        F.avg(F.col("value") * F.col("other")).alias("xy"), F.avg(F.col("value") * F.col("value")).alias("xx"), F.avg(F.col("other") * F.col("other")).alias("yy")
    )
    ratio = safe_div(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    return s.select("matrix_id", F.sqrt(F.greatest(ratio, F.lit(0.0))).alias("dcor"))


def _labelled(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """adj with the labels of both ends; labels(i, label) has a row a node."""
    a, b = labels.select("i", F.col("label").alias("li")), labels.select(F.col("i").alias("j"), F.col("label").alias("lj"))
    return adj.join(a, "i").join(b, "j")


def label_distances(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """label, within, n, mean: edges inside each label, and from it to others (once for each side)."""
    named = _labelled(adj, labels)
    within = named.filter("li = lj").select(F.col("li").alias("label"), F.lit(True).alias("within"), "value")
    across = named.filter("li <> lj").select(F.explode(F.array("li", "lj")).alias("label"), F.lit(False).alias("within"), "value")
    return within.union(across).groupBy("label", "within").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def label_pair_means(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """la, lb, n, mean: edges of each pair of labels, la <= lb."""
    named = _labelled(adj, labels)
    return named.groupBy(F.least("li", "lj").alias("la"), F.greatest("li", "lj").alias("lb")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def silhouette(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """i, label, s = (b - a) / max(a, b): a the mean distance inside the label, b to all other nodes."""
    named = _labelled(adj, labels)
    ends = named.select(F.explode(F.array(F.struct(F.col("i").alias("node"), F.col("li").alias("label")), F.struct(F.col("j").alias("node"), F.col("lj").alias("label")))).alias("e"), (F.col("li") == F.col("lj")).alias("same"), "value")
    means = ends.groupBy("e.node", "e.label").agg(F.avg(F.when(F.col("same"), F.col("value"))).alias("a"), F.avg(F.when(~F.col("same"), F.col("value"))).alias("b"))
    return means.select(F.col("node").alias("i"), "label", safe_div(F.col("b") - F.col("a"), F.greatest("a", "b")).alias("s"))


def edge_ttest(adj: DataFrame) -> DataFrame:
    """i, j, n, mean, t: one-sample t over matrices, 0 where the error is 0."""
    s = adj.groupBy("i", "j").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return s.select("i", "j", "n", "mean", F.coalesce(safe_div(F.col("mean"), F.col("sd") / F.sqrt("n")), F.lit(0.0)).alias("t"))


def social_relations(square: DataFrame) -> DataFrame:
    """matrix_id, n, actor, partner, relationship variances, actor-partner and dyad covariances of a full
    round robin, n >= 4, by the method of moments. Missing pairs take the mean of their margins."""
    off = square.filter("i <> j")
    nodes = off.select("matrix_id", F.explode(F.array("i", "j")).alias("i")).distinct()
    grid = nodes.join(nodes.withColumnRenamed("i", "j"), "matrix_id").filter("i <> j")
    row = off.groupBy("matrix_id", "i").agg(F.avg("value").alias("rm"))
    col = off.groupBy("matrix_id", "j").agg(F.avg("value").alias("cm"))
    filled = (
        grid.join(off, ["matrix_id", "i", "j"], "left").join(row, ["matrix_id", "i"], "left").join(col, ["matrix_id", "j"], "left")
    ).select("matrix_id", "i", "j", F.coalesce("value", (F.coalesce("rm", F.lit(0.0)) + F.coalesce("cm", F.lit(0.0))) / 2).alias("value"))
    total = filled.groupBy("matrix_id").agg(F.avg("value").alias("g"), F.countDistinct("i").alias("n"))
    r = filled.groupBy("matrix_id", "i").agg(F.avg("value").alias("r"))
    c = filled.groupBy("matrix_id", F.col("j").alias("i")).agg(F.avg("value").alias("c"))
    n = F.col("n")
    common = (n - 1) / (n * (n - 2))
    effects = r.join(c, ["matrix_id", "i"]).join(total.filter("n >= 4"), "matrix_id")
    alpha = common * (n - 1) * F.col("r") + common * F.col("c") - (n - 1) / (n - 2) * F.col("g")
    beta = common * (n - 1) * F.col("c") + common * F.col("r") - (n - 1) / (n - 2) * F.col("g")
    effects = effects.select("matrix_id", "i", "n", "g", alpha.alias("a"), beta.alias("b"))
    b = effects.select("matrix_id", F.col("i").alias("j"), F.col("a").alias("aj"), F.col("b").alias("bj"))
    rel = filled.join(effects, ["matrix_id", "i"]).join(b, ["matrix_id", "j"]).select("matrix_id", "i", "j", (F.col("value") - F.col("a") - F.col("bj") - F.col("g")).alias("e"))
    mirrored = rel.select("matrix_id", F.col("j").alias("i"), F.col("i").alias("j"), F.col("e").alias("f"))
    dyads = rel.join(mirrored, ["matrix_id", "i", "j"]).filter("i < j")
    plus, minus = F.col("e") + F.col("f"), F.col("e") - F.col("f")
    dyad = dyads.groupBy("matrix_id").agg((F.sum(plus * plus) / 2).alias("sp"), (F.sum(minus * minus) / 2).alias("sm"))
    unique = effects.groupBy("matrix_id", "n").agg(
        F.sum(F.col("a") * F.col("a")).alias("saa"), F.sum(F.col("b") * F.col("b")).alias("sbb"), F.sum(F.col("a") * F.col("b")).alias("sab")
    )
    j = unique.join(dyad, "matrix_id")
    ms_b, ms_w = F.col("sp") / ((n - 1) * (n - 2) / 2 - 1), F.col("sm") / ((n - 1) * (n - 2) / 2)
    rel_var, rel_cov = (ms_b + ms_w) / 2, (ms_b - ms_w) / 2
    shared = (n - 1) / (n * (n - 2))
    return j.select(
        "matrix_id",
        "n",
        (F.col("saa") / (n - 1) - shared * rel_var - rel_cov / (n * (n - 2))).alias("actor"),
        (F.col("sbb") / (n - 1) - shared * rel_var - rel_cov / (n * (n - 2))).alias("partner"),
        rel_var.alias("relationship"),
        (F.col("sab") / (n - 1) - shared * rel_cov - rel_var / (n * (n - 2))).alias("actor_partner"),
        rel_cov.alias("dyad"),
    )


def spearman_vectors(frame: DataFrame) -> DataFrame:
    """images with their values replaced by average ranks, each image on its own."""
    v = F.col("values")
    # the rank of x: values below it, and half of those equal to it
    ranks = F.transform(
        v, lambda x: F.aggregate(v, F.lit(0.0), lambda s, y: s + F.when(y < x, 1.0).when(y == x, 0.5).otherwise(0.0)) + 0.5
    )
    return frame.withColumn("values", ranks)


def centred(frame: DataFrame) -> DataFrame:
    return frame.withColumn("values", array_center(F.col("values")))


def threshold_by_p(stats: DataFrame, cut: float, binary: bool = False) -> DataFrame:
    """stats(..., stat, p): the statistic where p < cut, 0 elsewhere; nothing for a cut of 0 or less."""
    passed = (F.col("p") < cut) & F.lit(cut > 0)
    return stats.withColumn("stat", F.when(passed, F.lit(1.0) if binary else F.col("stat")).otherwise(F.lit(0.0)))


def multi_threshold(stats: DataFrame, cuts: list[float]) -> DataFrame:
    """Over several cuts, how often the statistic passes and is positive less how often it is negative."""
    count = sum((F.when((F.col("p") < c) & F.lit(c > 0), F.signum("stat")).otherwise(F.lit(0.0)) for c in cuts), F.lit(0.0))
    return stats.withColumn("stat", count)


def corrected_distance_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """matrix_id, n, dcor2, t, df: the bias-corrected squared distance correlation and its t-test."""
    x, y = u_center(a), u_center(b).withColumnRenamed("value", "other")
    s = x.join(y, ["matrix_id", "i", "j"]).groupBy("matrix_id").agg(
        F.countDistinct("i").alias("n"),
        F.sum(F.col("value") * F.col("other")).alias("xy"),
        F.sum(F.col("value") * F.col("value")).alias("xx"),
        F.sum(F.col("other") * F.col("other")).alias("yy"),
    )
    r = safe_div(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    made = s.select("matrix_id", "n", r.alias("dcor2"), (F.col("n") * (F.col("n") - 3) / 2 - 1).alias("df"))
    t = F.sqrt("df") * safe_div(F.col("dcor2"), F.sqrt(F.greatest(1 - F.col("dcor2") * F.col("dcor2"), F.lit(0.0))))
    return made.withColumn("t", t)


def label_distance_test(adj: DataFrame, labels: DataFrame, moves: DataFrame) -> DataFrame:
    """label, stat, p: mean distance to others less inside each label, under labels moved among nodes by
    moves(replicate, i, to); replicate 0 moves nothing."""
    from tessera.operators.inference import p_from_replicates

    moved = labels.join(moves, "i").select("replicate", F.col("to").alias("i"), "label")
    a = moved.select("replicate", "i", F.col("label").alias("li"))
    b = moved.select("replicate", F.col("i").alias("j"), F.col("label").alias("lj"))
    named = adj.join(sent(a), "i").join(sent(b), ["replicate", "j"])
    ends = named.select("replicate", F.explode(F.array_distinct(F.array("li", "lj"))).alias("label"), (F.col("li") == F.col("lj")).alias("same"), "value")
    diff = F.avg(F.when(~F.col("same"), F.col("value"))) - F.avg(F.when(F.col("same"), F.col("value")))
    return p_from_replicates(ends.groupBy("replicate", "label").agg(diff.alias("value")).filter("value IS NOT NULL"), ["label"])
