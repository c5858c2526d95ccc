"""Cross-validated prediction from sums: ridge, ridge classifier, lasso and linear discriminants.

A region's model needs its cross products for each fold and class, a few hundred numbers. Tasks make
those of their own samples as matrix products and sums meet on the executors; a training set's are the total
less the fold's. What is solved for each region is small, and regions are spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sums import sum_arrays_by


#: Numbers of sums that a task holds before it hands them on.
HELD = 1 << 22


def region_sums(frame: DataFrame, by: Sequence[str], features: str, target: str, fold: str) -> DataFrame:
    """by..., fold, class, n, sums, grams (upper triangle by rows): of feature arrays, for each fold and value of the target.

    A task adds up cross products of its own samples as matrix products, HELD numbers at most at a time; sums of a
    region, fold and class meet on the executors FAN at a time, so no region is one task's, however many its samples.
    Rows without a target or features, or with null or non-finite ones, take no part. Arrays of two lengths in a region are an error.
    """
    kinds = dict(frame.dtypes)
    named = F.struct(*by, F.col(fold).alias("fold"), F.col(target).cast("double").alias("class"))
    rows = frame.filter(F.col(target).isNotNull() & F.col(features).isNotNull()).select(F.to_json(named, {"ignoreNullFields": "false"}).alias("key"), F.col(features).cast("array<double>").alias("x"))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, np.ndarray]]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for key, group in batch.groupby("key"):
                x = np.stack([np.asarray(v, float) for v in group["x"]])
                x = x[np.isfinite(x).all(axis=1)]
                if len(x):
                    made = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x)[np.triu_indices(x.shape[1])]])[None, :]
                    held[key] = held[key] + made if key in held else made
            if sum(v.size for v in held.values()) > HELD:
                yield from held.items()
                held = {}
        yield from held.items()

    pieces = sum_arrays_by(rows, "string", products)
    whole = pieces.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "flat"))), lambda c: c["flat"])).alias("v"))
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), f"fold {kinds[fold]}", "class double"])
    # size(v) = 1 + k + k (k + 1) / 2
    k = ((F.sqrt(8 * F.size("v") + 1.0) - 3) / 2).cast("int")
    split = whole.select(F.from_json("key", schema).alias("of"), "v", k.alias("k"))
    return split.select("of.*", F.get("v", F.lit(0)).alias("n"), F.slice("v", F.lit(2), F.col("k")).alias("sums"), F.slice("v", F.col("k") + 2, F.size("v")).alias("grams"))


def _unpack(row) -> tuple[float, np.ndarray, np.ndarray]:
    s = np.asarray(row.sums, float)
    g = np.zeros((len(s), len(s)))
    g[np.triu_indices(len(s))] = row.grams
    return float(row.n), s, g + np.triu(g, 1).T


def lasso(gram: np.ndarray, xy: np.ndarray, alpha: float, n: float, rounds: int = 200) -> np.ndarray:
    """Coordinate descent on 1 / (2 n) |y - X b|^2 + alpha |b| from cross products of centred data."""
    beta = np.zeros(len(xy))
    for _ in range(rounds):
        before = beta.copy()
        for j in range(len(xy)):
            if gram[j, j] > 0:
                r = xy[j] - gram[j] @ beta + gram[j, j] * beta[j]
                beta[j] = np.sign(r) * max(abs(r) - n * alpha, 0.0) / gram[j, j]
        if np.abs(beta - before).max() < 1e-10:
            break
    return beta


def linear_weights(n: dict, s: dict, g: dict, model: str, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and intercept from class counts, sums and Gram matrices of a training set."""
    total, sums, gram = sum(n.values()), sum(s.values()), sum(g.values())
    mean = sums / total
    k = len(mean)
    if model == "lda":
        zero, one = sorted(n)[0], sorted(n)[-1]
        within = (gram - sum(np.outer(s[c], s[c]) / n[c] for c in n)) / max(total - len(n), 1)
        m0, m1 = s[zero] / n[zero], s[one] / n[one]
        w = np.linalg.solve(within + 1e-9 * np.trace(within) / k * np.eye(k) + 1e-12 * np.eye(k), m1 - m0)
        return w, float(-w @ (m0 + m1) / 2 + np.log(n[one] / n[zero]))
    y = {c: (1.0 if c == max(n) else -1.0) if model == "ridge_classifier" else c for c in n}
    ybar = sum(n[c] * y[c] for c in n) / total
    xy = sum(y[c] * s[c] for c in n) - total * ybar * mean
    centred = gram - total * np.outer(mean, mean)
    w = lasso(centred, xy, alpha, total) if model == "lasso" else np.linalg.solve(centred + alpha * np.eye(k), xy)
    return w, float(ybar - w @ mean)


def cross_validated_weights(sums: DataFrame, by: Sequence[str], model: str, alpha: float = 1.0) -> DataFrame:
    """by..., fold, weights, intercept: trained without the fold; fold -1 is trained on all."""
    kinds = dict(sums.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = {(r.fold, getattr(r, "class_")): _unpack(r) for r in group.rename(columns={"class": "class_"}).itertuples(index=False)}
        rows = []
        for held in [*sorted({f for f, _ in parts}), None]:
            n, s, g = {}, {}, {}
            for (f, c), (pn, ps, pg) in parts.items():
                if f != held:
                    n[c], s[c], g[c] = n.get(c, 0.0) + pn, s.get(c, 0.0) + ps, g.get(c, 0.0) + pg
            if len(n) > 1:
                w, b = linear_weights(n, s, g, model, alpha)
                rows.append([*(group[k].iloc[0] for k in by), -1 if held is None else held, w.tolist(), b])
        return pd.DataFrame(rows, columns=[*by, "fold", "weights", "intercept"])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), f"fold {kinds['fold']}", "weights array<double>", "intercept double"])
    return sums.groupBy(*by).applyInPandas(run, schema)


def cross_validated_scores(frame: DataFrame, weights: DataFrame, by: Sequence[str], features: str, target: str, fold: str, classify: bool) -> DataFrame:
    """by..., fold, n, score: accuracy, or 1 - SSE / SST, of each held-out fold.

    Samples meet their fold's weights by an equi-join, which Spark broadcasts only where the weights turn out small.
    Rows without a target or with missing features are not scored."""
    w = weights.withColumnRenamed("fold", "w_fold")
    on = [frame[k] == w[k] for k in by] + [frame[fold] == w["w_fold"]]
    value = F.aggregate(F.zip_with(frame[features], w["weights"], lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) + w["intercept"]
    joined = frame.join(w, on).select(*[frame[k] for k in by], frame[fold].alias("fold"), frame[target].cast("double").alias("y"), value.alias("p"))
    joined = joined.filter("y IS NOT NULL AND p IS NOT NULL AND NOT isnan(p)")
    if classify:
        score = F.avg((F.when(F.col("p") > 0, 1).otherwise(0) == F.col("y")).cast("double"))
    else:
        sst = F.sum(F.col("y") * F.col("y")) - F.sum("y") * F.sum("y") / F.count(F.lit(1))
        score = 1 - F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))) / (sst + 1e-10)
    return joined.groupBy(*by, "fold").agg(F.count(F.lit(1)).alias("n"), score.alias("score"))
