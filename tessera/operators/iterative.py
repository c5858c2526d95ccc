"""Models fitted by rounds over the data: logistic regression, squared-hinge classifiers, banded ridge,
principal components.

A round's gradient and curvature are sums over samples, a few hundred numbers for each region: tasks add up theirs,
sums meet and are solved on the executors, and the driver gets a vector a region. Samples are saved once for the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sums import sum_arrays, sum_arrays_by
from tessera.sources.scratch import Scratch


#: Numbers of sums that a task holds before it hands them on.
HELD = 1 << 22


def _steps(frame: DataFrame, kind: str, weights: dict, loss: str, c: float) -> dict:
    """region -> (Newton's step, the largest change in it) at its weights, of the regions in weights or, without any, all;
    features get a leading one for the intercept. Curvatures are summed and solved on the executors."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, np.ndarray]]:
        held: dict = {}
        for batch in batches:
            for key, group in batch.groupby("region"):
                if weights and key not in weights:
                    continue
                x = np.stack([np.asarray(v, float) for v in group["x"]])
                fine = np.isfinite(x).all(axis=1)
                x = np.column_stack([np.ones(fine.sum()), x[fine]])
                y = 2.0 * group["y"].to_numpy(float)[fine] - 1
                z = x @ weights.get(key, np.zeros(x.shape[1]))
                if loss == "logistic":
                    p = 1 / (1 + np.exp(np.clip(y * z, -30, 30)))
                    g, h = x.T @ (-y * p), (x * (p * (1 - p))[:, None]).T @ x
                else:  # squared hinge
                    on = (1 - y * z > 0).astype(float)
                    g, h = x.T @ (-2 * y * on * (1 - y * z)), 2 * (x * on[:, None]).T @ x
                made = np.concatenate([g, h.reshape(-1)])[None, :]
                held[key] = held[key] + made if key in held else made
            if sum(v.size for v in held.values()) > HELD:
                yield from held.items()
                held = {}
        yield from held.items()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for key, cells in zip(batch["key"], batch["v"], strict=True):
                v = np.asarray(cells, float)
                k = int((np.sqrt(1 + 4 * len(v)) - 1) / 2)
                g, h = v[:k], v[k:].reshape(k, k)
                ridge = np.eye(k)
                ridge[0, 0] = 1e-9
                found.append(np.linalg.solve(c * h + ridge, c * g + ridge @ weights.get(key, np.zeros(k))))
            yield pd.DataFrame({"key": batch["key"], "step": found})

    pieces = sum_arrays_by(frame, kind, products)
    whole = pieces.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "flat"))), lambda p: p["flat"])).alias("v"))
    return {row["key"]: np.array(row["step"]) for row in whole.mapInPandas(solve, f"key {kind}, step array<double>").collect()}  # a vector a region


def newton_classifier(frame: DataFrame, region: str, features: str, target: str, loss: str = "logistic", c: float = 1.0, rounds: int = 25, tolerance: float = 1e-8) -> dict:
    """region -> weights (the intercept first) of |w|^2 / 2 + c * loss, by Newton's steps on summed
    gradients; the intercept is not penalised. Targets are 0 and 1.

    Samples are saved once in the shared folder for the passes. A region is passed over until no weight moves by
    `tolerance` (relative to the largest, at least 1); if some still move after `rounds` passes, an error names them.
    Rows without region, target or features, or with null or non-finite ones, take no part.
    """
    if loss not in ("logistic", "squared_hinge"):
        raise ValueError(f"loss is logistic or squared_hinge, not {loss!r}")
    named = frame.select(F.col(region).alias("region"), F.col(target).cast("double").alias("y"), F.col(features).cast("array<double>").alias("x")).dropna()
    kind = dict(named.dtypes)["region"]
    weights: dict = {}
    with Scratch(frame.sparkSession, "newton") as scratch:
        rows = scratch.save(named)
        open_: dict = {}
        for _ in range(rounds):
            left = {}
            for key, step in _steps(rows, kind, open_, loss, c).items():
                w = weights[key] = weights.get(key, np.zeros(len(step))) - step
                if np.abs(step).max() > tolerance * max(1.0, np.abs(w).max()):
                    left[key] = w
            open_ = left
            if not open_:
                return weights
    raise RuntimeError(f"weights of {sorted(map(str, open_))[:10]} did not settle in {rounds} passes")


def dirichlet_weights(bands: int, n: int, concentrations: Sequence[float] = (0.1, 1.0), seed: int = 0) -> np.ndarray:
    """Random weights of bands that sum to 1, the concentrations in turn; the first is even."""
    rng = np.random.default_rng(seed)
    rows = [rng.dirichlet(np.full(bands, concentrations[k % len(concentrations)])) for k in range(n - 1)]
    return np.stack([np.full(bands, 1 / bands), *rows])


def banded_ridge(fold_sums: DataFrame, bands: Sequence[int], alphas: Sequence[float], n_weights: int = 20, seed: int = 0) -> pd.DataFrame:
    """fold_sums: cross_products by fold. bands gives each column's band. All band weights and alphas are
    scored by folds from the same sums: weights and alpha with their mean held-out r2, best first."""
    table = fold_sums.toPandas()  # a row a fold
    k = len(bands)
    grams = np.zeros((len(table), k, k))
    for i, packed in enumerate(table["xx"]):
        grams[i][np.triu_indices(k)] = packed
        grams[i] += np.triu(grams[i], 1).T
    xys, yys = np.stack(table["xy"].to_list()), table["yy"].to_numpy()
    sst = yys - table["sy"].to_numpy() ** 2 / table["n"].to_numpy()
    rows = []
    for gamma in dirichlet_weights(max(bands) + 1, n_weights, seed=seed):
        scale = np.sqrt(gamma[list(bands)])
        g, xy = grams * scale[:, None] * scale[None, :], xys * scale
        for alpha in alphas:
            r2 = []
            for i in range(len(g)):
                beta = np.linalg.solve(g.sum(0) - g[i] + alpha * np.eye(k), xy.sum(0) - xy[i])
                sse = yys[i] - 2 * beta @ xy[i] + beta @ g[i] @ beta
                r2.append(1 - sse / (sst[i] + 1e-10))
            rows.append((float(alpha), gamma.tolist(), float(np.mean(r2))))
    return pd.DataFrame(rows, columns=["alpha", "band_weights", "r2"]).sort_values("r2", ascending=False, kind="stable").reset_index(drop=True)


def principal_components(gram: DataFrame, means: DataFrame, n: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Components (rows) and explained variances from gram(x, y, value) of uncentred vectors and
    means(voxel_id, value): a table of elements by elements, whatever the number of samples, which the driver
    gets, so for few elements; `leading_components` is for any number. The largest entry of a component is positive."""
    mean = np.array([r["value"] for r in means.orderBy("voxel_id").collect()])
    k = len(mean)
    m = np.zeros((k, k))
    for r in gram.collect():
        m[r["x"], r["y"]] = m[r["y"], r["x"]] = r["value"]
    values, vectors = np.linalg.eigh((m - samples * np.outer(mean, mean)) / (samples - 1))
    order = np.argsort(values)[::-1][:n]
    parts = vectors[:, order].T
    parts = parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])[:, None]
    return parts, values[order]


def leading_components(frame: DataFrame, n: int, rounds: int = 30, tolerance: float = 1e-9, values: str = "values", seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n principal components (rows) and explained variances of a table of vectors of one length.

    Block Lanczos: a pass multiplies the covariance with a block of n + 5 directions, and what is new in
    the product is the next block, until the first n components change by less than `tolerance` of the
    largest variance, or nothing new is left; an error after `rounds` passes. The driver holds directions, n + 5
    vectors a pass, never elements by elements. Null and NaN values are an error. At most as many components as
    elements; fewer than two vectors are an error. The largest entry of a component is positive.
    """
    vectors = frame.select(values)

    def stacked(batch: pd.DataFrame) -> np.ndarray:
        return np.stack(batch[values].to_list()).astype(float)

    def first(batch: pd.DataFrame) -> np.ndarray:
        x = stacked(batch)
        return np.concatenate([[len(x)], x.sum(axis=0)])

    sums = sum_arrays(vectors, first)
    if sums is None or sums[0] < 2:
        raise ValueError("components need two vectors at least")
    if not np.isfinite(sums).all():
        raise ValueError("vectors hold null or non-finite values")
    samples, mean = sums[0], sums[1:] / sums[0]
    n = min(n, len(mean))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(mean), min(n + 5, len(mean)))))[0]
    basis, images = np.empty((len(mean), 0)), np.empty((len(mean), 0))
    for _ in range(rounds):

        def product(batch: pd.DataFrame, q: np.ndarray = q) -> np.ndarray:
            x = stacked(batch) - mean
            return x.T @ (x @ q)

        made = sum_arrays(vectors, product) / (samples - 1)
        basis, images = np.hstack([basis, q]), np.hstack([images, made])
        inner = basis.T @ images
        found, turns = np.linalg.eigh((inner + inner.T) / 2)
        found, turns = found[::-1][:n], turns[:, ::-1][:, :n]
        parts = basis @ turns
        rest = np.linalg.norm(images @ turns - parts * found, axis=0)
        for _ in range(2):  # twice, against rounding
            made = made - basis @ (basis.T @ made)
        new, sizes, _ = np.linalg.svd(made, full_matrices=False)
        q = new[:, sizes > 1e-10 * max(found[0], 1e-300)]
        if rest.max() <= tolerance * found[0] or not q.shape[1]:
            parts = parts.T
            return parts * np.sign(parts[np.arange(n), np.abs(parts).argmax(axis=1)])[:, None], found
    raise RuntimeError(f"components did not settle in {rounds} passes")


def map_groups(frame: DataFrame, by: str, function, schema: str) -> DataFrame:
    """Any function of one subject's rows (a pandas frame) to rows: the surface for users' own code."""
    return frame.groupBy(by).applyInPandas(function, schema)
