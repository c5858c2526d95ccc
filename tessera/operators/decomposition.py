"""Decompositions of a table of vectors, and the same by folds: components, independent components,
non-negative factors, dictionaries and factor analysis.

A model is a few vectors as long as the data's, on the driver and in every task; rows stay where they are. What a
round needs of the rows are sums over them (`sum_arrays`). A row's own factor is a function of the row and
the model, so it is made again in each pass and never kept, shuffled or written.

Models trained without a fold come from one pass for all folds: a row counts in the sums of each model but
that of its own fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.sums import sum_arrays
from tessera.sources.scratch import Scratch


@dataclass
class Model:
    """What maps a row x to its scores: (x - mean) @ forward.T; scores @ back + mean is its image."""

    mean: np.ndarray
    forward: np.ndarray
    back: np.ndarray
    variance: np.ndarray
    #: Whether the rounds that made it came to rest.
    settled: bool = True


def stacked(batch: pd.DataFrame, values: str) -> np.ndarray:
    return np.stack(batch[values].to_list()).astype(float)


def _others(batch: pd.DataFrame, fold: str | None, folds: list) -> np.ndarray:
    """1 where a row counts in the model of a fold: rows x folds."""
    if fold is None:
        return np.ones((len(batch), 1))
    return (batch[fold].to_numpy()[:, None] != np.array(folds, object)[None, :]).astype(float)


def fold_keys(frame: DataFrame, fold: str | None) -> list:
    """The folds in order, each with a model trained without it; [None] for one model of all rows."""
    return [None] if fold is None else sorted(r[0] for r in frame.select(fold).distinct().collect())


def components_by_fold(
    frame: DataFrame, n: int, fold: str | None = None, rounds: int = 30, tolerance: float = 1e-9, values: str = "values", seed: int = 0
) -> dict:
    """fold -> Model of the first n principal components of the rows outside the fold (None -> of all rows).

    Block Lanczos for all folds in the same passes: a pass multiplies every training set's covariance with its
    own block of directions, as one product of the rows with all blocks. As `leading_components` otherwise: an error
    after `rounds` passes, for fewer than two training rows, and for null or non-finite values; the largest entry of a
    component is positive. A row with a null fold counts in every model.
    """
    folds = fold_keys(frame.filter(F.col(fold).isNotNull()) if fold else frame, fold)
    rows = frame.select(values, *([fold] if fold else []))

    def first(batch: pd.DataFrame) -> np.ndarray:
        x, own = stacked(batch, values), _others(batch, fold, folds)
        return np.hstack([own.sum(axis=0)[:, None], own.T @ x])

    sums = sum_arrays(rows, first)
    if sums is None or sums[:, 0].min() < 2:
        raise ValueError("components need two training vectors at least")
    if not np.isfinite(sums).all():
        raise ValueError("vectors hold null or non-finite values")
    counts, means = sums[:, 0], sums[:, 1:] / sums[:, :1]
    width = means.shape[1]
    n = min(n, width)
    rng = np.random.default_rng(seed)
    start = np.linalg.qr(rng.standard_normal((width, min(n + 5, width))))[0]
    blocks = {f: start for f in range(len(folds))}
    basis = {f: np.empty((width, 0)) for f in blocks}
    images = {f: np.empty((width, 0)) for f in blocks}
    done: dict = {}
    for _ in range(rounds):
        live = sorted(blocks)
        ends = np.cumsum([0, *(blocks[f].shape[1] for f in live)])

        def product(batch: pd.DataFrame, live: list = live, ends: np.ndarray = ends, q: np.ndarray = np.hstack([blocks[f] for f in live])) -> np.ndarray:
            # centred on the first mean for all; the rest of a training set's own centre is taken off after
            x, own = stacked(batch, values) - means[0], _others(batch, fold, folds)
            turned = x @ q
            for k, f in enumerate(live):
                turned[:, ends[k] : ends[k + 1]] *= own[:, f : f + 1]
            return x.T @ turned

        made = sum_arrays(rows, product)
        for k, f in enumerate(live):
            off = means[f] - means[0]
            new = (made[:, ends[k] : ends[k + 1]] - counts[f] * np.outer(off, off @ blocks[f])) / (counts[f] - 1)
            basis[f], images[f] = np.hstack([basis[f], blocks[f]]), np.hstack([images[f], new])
            inner = basis[f].T @ images[f]
            found, turns = np.linalg.eigh((inner + inner.T) / 2)
            found, turns = found[::-1][:n], turns[:, ::-1][:, :n]
            parts = basis[f] @ turns
            rest = np.linalg.norm(images[f] @ turns - parts * found, axis=0)
            for _ in range(2):  # twice, against rounding
                new = new - basis[f] @ (basis[f].T @ new)
            left, sizes, _ = np.linalg.svd(new, full_matrices=False)
            blocks[f] = left[:, sizes > 1e-10 * max(found[0], 1e-300)]
            if rest.max() <= tolerance * found[0] or not blocks[f].shape[1]:
                parts = parts.T * np.sign(parts.T[np.arange(n), np.abs(parts).argmax(axis=0)])[:, None]
                done[folds[f]] = Model(means[f], parts, parts, np.maximum(found, 0.0))
                del blocks[f]
        if not blocks:
            return done
    raise RuntimeError(f"components did not settle in {rounds} passes")


def transform(frame: DataFrame, model: Model, values: str = "values", scores: str = "scores") -> DataFrame:
    """frame with each row's scores in place of its values."""
    kept = [c for c in frame.columns if c != values]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                made = (stacked(batch, values) - model.mean) @ model.forward.T
                yield batch[kept].assign(**{scores: list(made)})

    schema = T.StructType([*(frame.schema[c] for c in kept), T.StructField(scores, T.ArrayType(T.DoubleType()))])
    return frame.mapInPandas(run, schema)


def inverse_transform(frame: DataFrame, model: Model, scores: str = "scores", values: str = "values") -> DataFrame:
    """frame with the vectors that its scores stand for."""
    back = Model(np.zeros(len(model.back)), model.back.T, model.forward, model.variance)
    made = transform(frame, back, scores, values)
    return made.withColumn(values, F.zip_with(values, F.lit([float(m) for m in model.mean]), lambda a, b: a + b))


def _decorrelated(w: np.ndarray) -> np.ndarray:
    """W (W W')^-1/2: the nearest rows at right angles."""
    u, _, v = np.linalg.svd(w)
    return u @ v


def independent_components(
    frame: DataFrame, n: int, fold: str | None = None, rounds: int = 100, tolerance: float = 1e-5, values: str = "values", seed: int = 0
) -> dict:
    """fold -> Model of n independent components of the rows outside the fold (None -> of all rows).

    The fixed point iteration for log cosh on whitened scores of `components_by_fold`, all components and folds at
    once: a pass sums z g(w z)' and g'(w z). Whitened scores, n numbers a row and fold, are saved once for the passes. Sources have
    variance one; they are in the order of the variance that they give the data, and the largest entry of a
    map is positive. `variance` is that of each map. A model that has not come to rest after `rounds` passes (as of normal
    data, which has no independent components) says so in `settled`; less variance than n directions is an error.
    """
    principal = components_by_fold(frame, n, fold, values=values, seed=seed)
    folds = list(principal)
    for m in principal.values():
        if m.variance[-1] <= 1e-10 * m.variance[0]:
            raise ValueError("fewer directions of variance than components")
    whiten = {f: m.forward / np.sqrt(m.variance)[:, None] for f, m in principal.items()}
    n = len(next(iter(whiten.values())))

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = stacked(batch, values)
                z = np.hstack([(x - principal[f].mean) @ whiten[f].T for f in folds])
                yield pd.DataFrame({"own": list(_others(batch, fold, folds)), "z": list(z)})

    out: dict = {}
    with Scratch(frame.sparkSession, "ica") as scratch:
        made = scratch.save(frame.select(values, *([fold] if fold else [])).mapInPandas(scores, "own array<double>, z array<double>"))
        w = np.stack([_decorrelated(np.random.default_rng(seed).standard_normal((n, n)))] * len(folds))
        settled = np.zeros(len(folds), bool)
        for _ in range(rounds):

            def passed(batch: pd.DataFrame, w: np.ndarray = w) -> np.ndarray:
                own, z = stacked(batch, "own"), stacked(batch, "z").reshape(len(batch), len(folds), n)
                g = np.tanh(np.einsum("rfi,fji->rfj", z, w))
                seen = np.einsum("rf,rfj,rfi->fji", own, g, z)
                slope = np.einsum("rf,rfj->fj", own, 1 - g * g)
                return np.concatenate([seen, slope[:, :, None], np.repeat(own.sum(axis=0)[:, None, None], n, axis=1)], axis=2)

            sums = sum_arrays(made, passed)
            new = np.stack([_decorrelated((s[:, :n] - s[:, n : n + 1] * old) / s[0, n + 1]) for s, old in zip(sums, w, strict=True)])
            moved = np.abs(np.abs(np.einsum("fji,fji->fj", new, w)) - 1).max(axis=1)
            w = np.where(settled[:, None, None], w, new)  # each fold stops by itself: no fold's rows show in another's rounds
            settled |= moved < tolerance
            if settled.all():
                break
    for f, turn, rests in zip(folds, w, settled.tolist(), strict=True):
        m = principal[f]
        back = turn @ (m.forward * np.sqrt(m.variance)[:, None])
        order = np.argsort(-(back**2).sum(axis=1), kind="stable")
        back, turn = back[order], turn[order]
        sign = np.sign(back[np.arange(n), np.abs(back).argmax(axis=1)])[:, None]
        out[f] = Model(m.mean, sign * (turn @ whiten[f]), sign * back, (back**2).sum(axis=1), rests)
    return out


def non_negative_codes(gram: np.ndarray, cross: np.ndarray, penalty: float = 0.0, signed: bool = False, sweeps: int = 1000) -> np.ndarray:
    """Rows w of least w gram w' / 2 - w cross' + penalty |w|, not negative unless `signed`, by coordinate descent to
    rest. A coordinate without weight in gram stays 0."""
    w = np.zeros_like(cross)
    slope = -cross.copy()  # w @ gram - cross
    width = np.diag(gram)
    live = np.flatnonzero(width > 1e-300)
    scale = np.abs(cross).max(initial=0.0) + 1e-300
    for _ in range(sweeps):
        moved = 0.0
        for j in live:
            to = w[:, j] * width[j] - slope[:, j]
            to = np.sign(to) * np.maximum(np.abs(to) - penalty, 0.0) if signed else np.maximum(to - penalty, 0.0)
            step = to / width[j] - w[:, j]
            w[:, j] += step
            slope += step[:, None] * gram[j]
            moved = max(moved, float(np.abs(step).max(initial=0.0)) * width[j])
        if moved <= 1e-12 * scale:
            break
    return w


@dataclass
class Factors:
    """Parts (k x width) of a factorisation; the objective after each round; whether it settled within the rounds."""

    parts: np.ndarray
    objective: list
    settled: bool
    penalty: float = 0.0
    signed: bool = False


def factor_codes(x: np.ndarray, parts: np.ndarray, penalty: float, signed: bool) -> np.ndarray:
    return non_negative_codes(parts @ parts.T, x @ parts.T, penalty, signed)


def _factored(rows: DataFrame, values: str, parts: np.ndarray, penalty: float, signed: bool, rounds: int, tolerance: float, update) -> Factors:
    """Rounds of codes in the tasks and `update` of the parts from the codes' Gram and cross products."""
    k, objective = len(parts), []
    for _ in range(rounds):

        def passed(batch: pd.DataFrame, parts: np.ndarray = parts) -> np.ndarray:
            x = stacked(batch, values)
            w = factor_codes(x, parts, penalty, signed)
            loss = np.full((k, 1), ((x - w @ parts) ** 2).sum() / 2 + penalty * np.abs(w).sum())
            return np.hstack([w.T @ w, w.T @ x, loss])

        sums = sum_arrays(rows, passed)
        objective.append(float(sums[0, -1]))
        if len(objective) > 1 and objective[-2] - objective[-1] <= tolerance * objective[0]:
            return Factors(parts, objective, True, penalty, signed)
        parts = update(parts, sums[:, :k], sums[:, k:-1])
    return Factors(parts, objective, False, penalty, signed)


def _checked(rows: DataFrame, values: str, least: float) -> np.ndarray:
    """(count, smallest value is right, sums) of the rows' elements; errors for what no factorisation takes."""

    def first(batch: pd.DataFrame) -> np.ndarray:
        x = stacked(batch, values)
        return np.concatenate([[len(x), float((x < least).sum())], x.sum(axis=0)])

    sums = sum_arrays(rows, first)
    if sums is None:
        raise ValueError("factors need one vector at least")
    if not np.isfinite(sums).all():
        raise ValueError("vectors hold null or non-finite values")
    if sums[1]:
        raise ValueError("vectors hold negative values")
    return sums


def non_negative_factors(frame: DataFrame, n: int, rounds: int = 100, tolerance: float = 1e-6, values: str = "values", seed: int = 0) -> Factors:
    """Non-negative parts whose non-negative sums come nearest to the vectors (least squares).

    Alternating non-negative least squares: a row's factor is the exact optimum for the parts at hand, and the parts
    are the optimum for the factors, solved from their Gram and cross products; the error never rises. Starts from the
    mean vector times random weights. Settled when a round gains no more than `tolerance` of the first error. Negative, null or
    non-finite values are errors; parts that no row uses go to zero.
    """
    rows = frame.select(values)
    sums = _checked(rows, values, 0.0)
    mean = sums[2:] / sums[0]
    start = mean * np.random.default_rng(seed).uniform(0.1, 2.0, (n, len(mean)))

    def update(parts: np.ndarray, gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
        return non_negative_codes(gram, cross.T).T

    return _factored(rows, values, start, 0.0, False, rounds, tolerance, update)


def dictionary(frame: DataFrame, n: int, penalty: float = 1.0, rounds: int = 100, tolerance: float = 1e-6, values: str = "values", seed: int = 0) -> Factors:
    """Atoms of length one at most whose sparse sums come nearest to the vectors: |x - w A|^2 / 2 + penalty |w|.

    A row's code is the exact lasso for the atoms at hand; atoms are moved one by one to their optimum within the unit ball, from the
    codes' Gram and cross products, so the objective never rises. An atom that no code uses stays. Starts
    from random directions. Null or non-finite values are errors.
    """
    rows = frame.select(values)
    width = len(_checked(rows, values, -np.inf)) - 2
    start = np.random.default_rng(seed).standard_normal((n, width))
    start /= np.linalg.norm(start, axis=1)[:, None]

    def update(parts: np.ndarray, gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
        parts = parts.copy()
        for _ in range(20):
            before = parts.copy()
            for j in np.flatnonzero(np.diag(gram) > 1e-12 * max(np.diag(gram).max(), 1e-300)):
                to = parts[j] + (cross[j] - gram[j] @ parts) / gram[j, j]
                parts[j] = to / max(1.0, np.linalg.norm(to))
            if np.abs(parts - before).max() < 1e-10:
                break
        return parts

    return _factored(rows, values, start, penalty, True, rounds, tolerance, update)


def encode(frame: DataFrame, factors: Factors, values: str = "values", codes: str = "codes") -> DataFrame:
    """frame with each row's factor in place of its values."""
    kept = [c for c in frame.columns if c != values]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                made = factor_codes(stacked(batch, values), factors.parts, factors.penalty, factors.signed)
                yield batch[kept].assign(**{codes: list(made)})

    schema = T.StructType([*(frame.schema[c] for c in kept), T.StructField(codes, T.ArrayType(T.DoubleType()))])
    return frame.mapInPandas(run, schema)


@dataclass
class FactorAnalysis:
    """x = mean + z loadings + noise of its own variance for each element; the log likelihood before each round."""

    mean: np.ndarray
    loadings: np.ndarray
    noise: np.ndarray
    likelihood: list
    settled: bool

    def posterior(self) -> np.ndarray:
        """The k x width matrix that maps x - mean to the expected factors."""
        scaled = self.loadings / self.noise
        return np.linalg.solve(np.eye(len(scaled)) + scaled @ self.loadings.T, scaled)

    def as_model(self) -> Model:
        return Model(self.mean, self.posterior(), self.loadings, (self.loadings**2).sum(axis=1))


def factor_analysis(frame: DataFrame, n: int, rounds: int = 200, tolerance: float = 1e-7, values: str = "values", seed: int = 0) -> FactorAnalysis:
    """n factors with a noise variance for each element, by EM from the principal components.

    A round is one pass: the covariance times the posterior's k rows. The likelihood never falls; settled when a round
    gains less than `tolerance` of it a row and element. Noise is held at 1e-12 of the largest variance at least, so that an element
    without noise is no error.
    """
    rows = frame.select(values)
    start = components_by_fold(frame, n, values=values, seed=seed)[None]
    mean = start.mean

    def spread(batch: pd.DataFrame) -> np.ndarray:
        x = stacked(batch, values) - mean
        return np.vstack([(x * x).sum(axis=0), np.full(x.shape[1], float(len(x)))])

    sums = sum_arrays(rows, spread)
    samples, variance = sums[1, 0], sums[0] / sums[1, 0]
    least = 1e-12 * max(variance.max(), 1e-300)
    loadings = start.forward * np.sqrt(start.variance)[:, None]
    out = FactorAnalysis(mean, loadings, np.maximum(variance - (loadings**2).sum(axis=0), 0.05 * variance + least), [], False)
    width = len(mean)
    for _ in range(rounds):
        beta = out.posterior()

        def product(batch: pd.DataFrame, beta: np.ndarray = beta) -> np.ndarray:
            x = stacked(batch, values) - mean
            return (x @ beta.T).T @ x

        moments = sum_arrays(rows, product) / samples  # beta @ covariance
        scaled = out.loadings / out.noise
        inner = np.eye(n) + scaled @ out.loadings.T
        trace = (variance / out.noise).sum() - (moments * scaled).sum()
        logdet = np.log(out.noise).sum() + np.linalg.slogdet(inner)[1]
        out.likelihood.append(float(-samples / 2 * (width * np.log(2 * np.pi) + logdet + trace)))
        if len(out.likelihood) > 1 and out.likelihood[-1] - out.likelihood[-2] < tolerance * samples * width:
            out.settled = True
            return out
        second = np.eye(n) - beta @ out.loadings.T + moments @ beta.T
        out.loadings = np.linalg.solve(second, moments)
        out.noise = np.maximum(variance - (out.loadings * moments).sum(axis=0), least)
    return out


def reduced_ridge(frame: DataFrame, target: str, fold: str, n: int, alpha: float = 1.0, method: str = "pca", values: str = "values", seed: int = 0) -> DataFrame:
    """fold, n, r2 of ridge on reduced vectors, both the reduction ("pca" or "ica") and the weights made without the fold.

    Two passes after the reduction: sums of scores times target over each training set, then squared errors of each
    held-out row. Scores of a training set are uncorrelated, so its Gram matrix is known from the variances. A row
    with a null fold is trained on and never scored; a null target is an error.
    """
    make = {"pca": components_by_fold, "ica": independent_components}[method]
    models = make(frame, n, fold, values=values, seed=seed)
    folds = list(models)
    rows = frame.select(values, fold, F.col(target).cast("double").alias("target"))

    def cross(batch: pd.DataFrame) -> np.ndarray:
        x, own, y = stacked(batch, values), _others(batch, fold, folds), batch["target"].to_numpy(float)
        made = [np.concatenate([[w.sum(), (w * y).sum()], (w * y) @ ((x - m.mean) @ m.forward.T)]) for w, m in zip(own.T, models.values(), strict=True)]
        return np.stack(made)

    sums = sum_arrays(rows, cross)
    if not np.isfinite(sums).all():
        raise ValueError("the target holds null or non-finite values")
    fits = {}
    for f, s in zip(folds, sums, strict=True):
        spread = models[f].variance if method == "pca" else np.ones(len(models[f].forward))
        fits[f] = (s[2:] / ((s[0] - 1) * spread + alpha), s[1] / s[0])

    def held(batch: pd.DataFrame) -> np.ndarray:
        x, y, out = stacked(batch, values), batch["target"].to_numpy(float), np.zeros((len(folds), 4))
        for k, f in enumerate(folds):
            own = (batch[fold] == f).to_numpy()
            if own.any():
                weights, level = fits[f]
                miss = y[own] - level - (x[own] - models[f].mean) @ models[f].forward.T @ weights
                out[k] = own.sum(), (miss * miss).sum(), y[own].sum(), (y[own] ** 2).sum()
        return out

    found = sum_arrays(rows, held)
    spark, kind = frame.sparkSession, dict(frame.dtypes)[fold]
    made = [(f, int(c), float(1 - sse / (yy - y * y / c)) if yy - y * y / c > 0 else 0.0) for f, (c, sse, y, yy) in zip(folds, found, strict=True)]
    return spark.createDataFrame(made, f"{fold} {kind}, n long, r2 double")
