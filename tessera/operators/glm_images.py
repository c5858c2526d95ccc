"""Linear models of whole images over time, with ordinary or first-order autoregressive noise.

images(run, t, values): an image a time, runs apart. design(run, t, columns...): its regressors, one row a time.

Everything comes from one pass of sums of products with the design as it is and shifted by one time:
for a voxel's series y and an autocorrelation rho the whitened products are

    X'X - rho (X'LX + LX'X) + rho^2 LX'LX      and the same with y,

L the shift. So no series is whitened or written again, whatever its voxel's rho: voxels of about the same rho
share one whitened Gram matrix. The only product that needs an image and the one before it is y'Ly; images meet in
blocks of BLOCK times, the last of a block also in the next, so a run of any length is many small pieces.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.distributions import t_sf2
from tessera.operators.models import parse_contrast
from tessera.operators.sums import sum_arrays_by

#: Times that one task works as a piece.
BLOCK = 64
#: Autocorrelations are cut (toward zero) to this many steps a unit.
BINS = 100


def numbered(design: DataFrame, columns: Sequence[str], run: str = "run", t: str = "t") -> DataFrame:
    """run, t, place (from 0 in the order of t), now, past and next: the design's rows at a time and at its sides
    (null at the ends). A design is as long as its runs and a few columns wide."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    order = Window.partitionBy(run).orderBy(t)
    rows = design.select(run, t, x.alias("now"))
    return rows.select(
        run, t, (F.row_number().over(order) - 1).alias("place"), "now", F.lag("now").over(order).alias("past"), F.lead("now").over(order).alias("next")
    )


def design_products(rows: DataFrame, k: int, run: str = "run") -> DataFrame:
    """run, n, now (X'X), cross (X'LX), past (LX'LX), row by row, of numbered()'s rows: a row a run."""

    def products(a: str, b: str):
        # a null row (before the first time) adds nothing
        return [F.coalesce(F.sum(F.col(a)[i] * F.col(b)[j]), F.lit(0.0)) for i in range(k) for j in range(k)]

    made = [F.array(*products(a, b)).alias(name) for name, a, b in (("xx", "now", "now"), ("xl", "now", "past"), ("ll", "past", "past"))]
    return rows.groupBy(run).agg(F.count(F.lit(1)).alias("n"), *made)


def image_products(images: DataFrame, rows: DataFrame, k: int, run: str = "run", t: str = "t", values: str = "values") -> DataFrame:
    """key (the run), at, flat: 3 k + 4 rows of sums a voxel: X'y, X'Ly + LX'y, LX'Ly, y'y, y'Ly, Ly'Ly and y's sum."""
    met = images.select(run, t, values).join(rows, [run, t])
    block = F.floor(F.col("place") / BLOCK)
    ends = F.when((F.col("place") % BLOCK == BLOCK - 1) & F.col("next").isNotNull(), F.array(block, block + 1)).otherwise(F.array(block))
    dealt = met.withColumn("home", block).withColumn("block", F.explode(ends)).repartition(run, "block").sortWithinPartitions(run, "block", "place")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, np.ndarray]]:
        key = total = last = None
        for batch in batches:
            if not len(batch):
                continue
            own = batch[[run, "block"]].to_numpy()
            cuts = np.flatnonzero(np.append(True, (own[1:] != own[:-1]).any(axis=1))).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                piece = batch.iloc[lo:hi]
                y = np.stack(piece[values].to_list()).astype(float)
                here = (piece["home"] == piece["block"]).to_numpy()
                place = piece["place"].to_numpy()
                if piece[run].iloc[0] != key:
                    if total is not None:
                        yield key, total
                    key, total, last = piece[run].iloc[0], np.zeros((3 * k + 4, y.shape[1])), None
                now = np.stack(piece["now"].to_list())
                past, after = (np.stack([np.zeros(k) if r is None else r for r in piece[c]]) for c in ("past", "next"))
                more = np.array([r is not None for r in piece["next"]])
                a, b = y[here], y[here & more]
                total[:k] += now[here].T @ a
                total[k : 2 * k] += (past + after)[here].T @ a
                total[2 * k : 3 * k] += now[here & more].T @ b
                total[3 * k] += (a * a).sum(axis=0)
                total[3 * k + 2] += (b * b).sum(axis=0)
                total[3 * k + 3] += a.sum(axis=0)
                # an image and the one before it, which may have come with the batch before
                before, series = (place, y) if last is None or last[0] != piece["block"].iloc[0] else (np.append(last[1], place), np.vstack([last[2], y]))
                follows = np.flatnonzero(before[1:] == before[:-1] + 1)
                total[3 * k + 1] += (series[follows + 1] * series[follows]).sum(axis=0)
                last = (piece["block"].iloc[0], place[-1:], y[-1:])
        if total is not None:
            yield key, total

    return sum_arrays_by(dealt.select(run, "block", "home", "place", "now", "past", "next", values), dict(images.dtypes)[run], add)


def _solved(columns: Sequence[str], contrasts: dict[str, np.ndarray], noise: str, run: str):
    k = len(columns)
    weights = np.stack(list(contrasts.values()))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                sums = np.asarray(r["flat"], float).reshape(3 * k + 4, -1)
                n, width = r["n"], sums.shape[1]
                xx, xl, ll = (np.asarray(r[c], float).reshape(k, k) for c in ("xx", "xl", "ll"))
                xy, cross, past = sums[:k], sums[k : 2 * k], sums[2 * k : 3 * k]
                yy, yl, lyly, total = sums[3 * k :]
                beta = np.linalg.pinv(xx, hermitian=True) @ xy
                rho = np.zeros(width)
                if noise == "ar1":
                    sse = yy - 2 * (beta * xy).sum(axis=0) + (beta * (xx @ beta)).sum(axis=0)
                    lagged = yl - (beta * cross).sum(axis=0) + (beta * (xl @ beta)).sum(axis=0)
                    rho = np.trunc(np.divide(lagged, sse, out=np.zeros(width), where=sse > 1e-12 * np.maximum(yy, 1e-300)) * BINS) / BINS
                effect, se, r2 = np.zeros((len(weights), width)), np.zeros((len(weights), width)), np.zeros(width)
                df = np.zeros(width)
                for p in np.unique(rho):
                    own = np.flatnonzero(rho == p)
                    gram = xx - p * (xl + xl.T) + p * p * ll
                    inverse = np.linalg.pinv(gram, hermitian=True)
                    right = xy[:, own] - p * cross[:, own] + p * p * past[:, own]
                    square = yy[own] - 2 * p * yl[own] + p * p * lyly[own]
                    b = inverse @ right
                    sse = np.maximum(square - 2 * (b * right).sum(axis=0) + (b * (gram @ b)).sum(axis=0), 0.0)
                    df[own] = n - np.linalg.matrix_rank(gram, hermitian=True)
                    left = np.where(df[own] > 0, sse / np.maximum(df[own], 1), np.nan)
                    effect[:, own] = weights @ b
                    se[:, own] = np.sqrt(np.maximum(((weights @ inverse) * weights).sum(axis=1), 0)[:, None] * left)
                    # of the series as they are: 1 - residual / total sum of squares
                    plain = yy[own] - 2 * (b * xy[:, own]).sum(axis=0) + (b * (xx @ b)).sum(axis=0)
                    spread = yy[own] - total[own] ** 2 / n
                    r2[own] = np.where(spread > 1e-12 * np.maximum(yy[own], 1e-300), 1 - plain / np.maximum(spread, 1e-300), 0.0)
                t = np.divide(effect, se, out=np.where(np.isnan(se), np.nan, 0.0), where=se > 1e-12)
                yield pd.DataFrame(
                    {
                        run: r["key"],
                        "voxel_id": np.tile(r["at"] + np.arange(width), len(weights)),
                        "term": np.repeat(list(contrasts), width),
                        "rho": np.tile(rho, len(weights)),
                        "effect": effect.reshape(-1),
                        "se": se.reshape(-1),
                        "t": t.reshape(-1),
                        "df": np.tile(df, len(weights)),
                        "p": t_sf2(t.reshape(-1), np.maximum(np.tile(df, len(weights)), 1)),
                        "r2": np.tile(r2, len(weights)),
                    }
                )

    return fit


def fit_images(
    images: DataFrame, design: DataFrame, columns: Sequence[str], noise: str = "ols", contrasts: dict[str, str] | None = None, run: str = "run", t: str = "t", values: str = "values"
) -> DataFrame:
    """run, voxel_id, term, rho, effect, se, t, df, p, r2 of each voxel of each run: the terms are the design's columns,
    or contrasts of them ("a - b").

    noise "ols": rho is 0. "ar1": a voxel's rho is the lag-one autocorrelation of its residuals by least squares, cut to
    hundredths, and design and series are whitened with it, the first time left as it is. t is 0 where the error
    is 0; t, se and p are NaN without degrees of freedom, which are the times less the rank. r2 is that of the series
    as they are. Times are in the order of t, neighbours in it one lag apart; a time without an image or a
    row of the design is left out on both sides. Images of a run have one length, and a run's times are distinct
    (errors otherwise by the sums' shapes). Null values are errors. Empty tables: empty result.
    """
    if noise not in ("ols", "ar1"):
        raise ValueError(f"noise is ols or ar1, not {noise!r}")
    k = len(columns)
    named = {c: parse_contrast(v, columns) for c, v in (contrasts or {}).items()} or dict(zip(columns, np.eye(k), strict=True))
    both = design.join(images.select(run, t).distinct(), [run, t], "left_semi")
    rows = numbered(both, columns, run, t)
    sums = image_products(images, rows, k, run, t, values)
    grams = design_products(rows, k, run)
    kind = dict(images.dtypes)[run]
    schema = f"{run} {kind}, voxel_id long, term string, rho double, effect double, se double, t double, df double, p double, r2 double"
    met = sums.join(grams, sums["key"] == grams[run]).select("key", "at", "flat", "n", "xx", "xl", "ll")
    return met.mapInPandas(_solved(columns, named, noise, run), schema)


def fixed_effects(fit: DataFrame) -> DataFrame:
    """voxel_id, term, effect, se, t, n_runs: runs of fit_images together, effects and error variances added up and
    divided by the number of runs. Runs without degrees of freedom count for nothing."""
    ok = fit.filter(~F.isnan("se"))
    made = ok.groupBy("voxel_id", "term").agg(F.avg("effect").alias("effect"), (F.sqrt(F.sum(F.col("se") * F.col("se"))) / F.count("*")).alias("se"), F.count("*").alias("n_runs"))
    return made.withColumn("t", F.when(F.col("se") > 1e-12, F.col("effect") / F.col("se")).otherwise(0.0))


def predict_images(images: DataFrame, design: DataFrame, fit: DataFrame, columns: Sequence[str], run: str = "run", t: str = "t", values: str = "values") -> DataFrame:
    """images with predicted and residual, vectors like values, from fit_images's terms (the design's columns).

    A run's coefficient rows (a row a regressor) go to each of its blocks of times and stay in the task for the images that follow.
    """
    k = len(columns)
    index = F.array_position(F.array(*map(F.lit, columns)), F.col("term")) - 1
    packed = F.transform(F.array_sort(F.collect_list(F.struct("voxel_id", "effect"))), lambda v: v["effect"])
    maps = fit.filter(F.col("term").isin(*columns)).groupBy(run, index.alias("kind")).agg(packed.alias(values))
    rows = numbered(design, columns, run, t).select(run, t, F.floor(F.col("place") / BLOCK).alias("block"), "now")
    kept = [c for c in images.columns if c not in (run, t, values)]
    seen = images.join(rows, [run, t]).select(run, "block", F.lit(-1).cast("long").alias("kind"), t, values, "now", *kept)
    blocks = rows.select(run, "block").distinct()
    kind_of = dict(images.dtypes)
    nulls = [F.lit(None).cast(kind_of[c]).alias(c) for c in kept]
    sent = blocks.join(maps, run).select(run, "block", "kind", F.lit(None).cast(kind_of[t]).alias(t), values, F.lit(None).cast("array<double>").alias("now"), *nulls)
    dealt = sent.unionByName(seen).repartition(run, "block").sortWithinPartitions(run, "block", F.col("kind").desc(), t)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, maps_now = None, {}
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                if (r[run], r["block"]) != key:
                    key, maps_now = (r[run], r["block"]), {}
                if r["kind"] >= 0:
                    maps_now[r["kind"]] = np.asarray(r[values], float)
                elif len(maps_now) == k:
                    fitted = sum(x * maps_now[j] for j, x in enumerate(r["now"]))
                    out.append([r[run], r[t], *(r[c] for c in kept), fitted, np.asarray(r[values], float) - fitted])
            yield pd.DataFrame(out, columns=[run, t, *kept, "predicted", "residual"])

    schema = ", ".join([f"{c} {kind_of[c]}" for c in (run, t, *kept)] + ["predicted array<double>", "residual array<double>"])
    return dealt.mapInPandas(predict, schema)
