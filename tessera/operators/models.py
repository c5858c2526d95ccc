"""Linear models, tests and contrasts: everything from moments that Spark sums.

A design has one row a sample, and its columns are few; so X'X and X'y are sums of products, one
aggregation over the samples, and what is solved is a small system for each target or group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import safe_div
from tessera.functions.distributions import f_sf, t_sf2
from tessera.operators.sizes import sent
from tessera.sources.scratch import keep


def one_sample_t(frame: DataFrame, value: str, by: Sequence[str], popmean: float = 0.0) -> DataFrame:
    """by..., n, mean, t; t is 0 where the error is 0. The mean is not shifted."""
    s = frame.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    t = F.coalesce(safe_div(F.col("mean") - popmean, F.col("sd") / F.sqrt("n")), F.lit(0.0))
    return s.select(*by, "n", "mean", t.alias("t"))


def two_sample_t(frame: DataFrame, value: str, first: Column, by: Sequence[str], equal_var: bool = True) -> DataFrame:
    """by..., mean (of the difference), t and df, pooled or by Welch and Satterthwaite."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    s = frame.groupBy(*by).agg(
        *[f(c).alias(f"{k}{i}") for i, c in ((1, a), (2, b)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    )
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    diff = F.col("m1") - F.col("m2")
    if equal_var:
        pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
        se, df = F.sqrt(pooled * (1 / n1 + 1 / n2)), (n1 + n2 - 2).cast("double")
    else:
        e1, e2 = v1 / n1, v2 / n2
        se, df = F.sqrt(e1 + e2), safe_div((e1 + e2) * (e1 + e2), e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1), None)
    return s.filter((n1 > 1) & (n2 > 1)).select(*by, diff.alias("mean"), safe_div(diff, se).alias("t"), df.alias("df"))


def anova(frame: DataFrame, value: str, group: str, by: Sequence[str]) -> DataFrame:
    """by..., f, df_between, df_within of one-way analysis of variance; f is 0 without variance within."""
    g = frame.groupBy(*by, group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    t = g.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b")
    )
    dfb, dfw = F.col("k") - 1, F.col("n") - F.col("k")
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    f = safe_div(safe_div(between, dfb), safe_div(within, dfw))
    return t.select(*by, f.alias("f"), dfb.alias("df_between"), dfw.alias("df_within"))


def simple_regression(frame: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """by..., n, intercept, slope, slope_se, t, r2 of y on x, from moments alone."""
    s = frame.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy")
    )
    n, slope = F.col("n"), safe_div(F.col("c"), F.col("vx"), None)
    sse = n * (F.col("vy") - slope * F.col("c"))
    se = F.sqrt(F.greatest(sse, F.lit(0.0)) / (n - 2) / (n * F.col("vx")))
    r2 = safe_div(F.col("c") * F.col("c"), F.col("vx") * F.col("vy"))
    return s.filter("n > 2 AND vx > 0").select(
        *by, "n", (F.col("my") - slope * F.col("mx")).alias("intercept"), slope.alias("slope"), se.alias("slope_se"), safe_div(slope, se).alias("t"), r2.alias("r2")
    )


def cross_products(frame: DataFrame, design: Sequence[str], target: str, by: Sequence[str]) -> DataFrame:
    """by..., n, xx (upper triangle, row by row), xy, yy: what a linear model needs of its samples."""
    xx = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(design) for b in design[i:]]
    xy = [F.sum(F.col(a) * F.col(target)) for a in design]
    t = F.col(target)
    return frame.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*xx).alias("xx"), F.array(*xy).alias("xy"), F.sum(t * t).alias("yy"), F.sum(t).alias("sy")
    )


def _gram(packed: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = packed
    return out + np.triu(out, 1).T


def _solver(design: Sequence[str], by: Sequence[str], alpha: float, contrasts: dict[str, np.ndarray] | None):
    k = len(design)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                gram, xy = _gram(r.xx, k), np.asarray(r.xy)
                inverse = np.linalg.pinv(gram + alpha * np.eye(k))
                beta = inverse @ xy
                sse = max(r.yy - 2 * beta @ xy + beta @ gram @ beta, 0.0)
                df = r.n - np.linalg.matrix_rank(gram)
                sigma2 = sse / df if df > 0 else np.nan
                sst = r.yy - r.sy * r.sy / r.n
                for name, c in (contrasts or {d: np.eye(k)[i] for i, d in enumerate(design)}).items():
                    se = np.sqrt(max(c @ inverse @ c * sigma2, 0.0)) if df > 0 else np.nan
                    effect = c @ beta
                    rows.append([*(getattr(r, b) for b in by), name, effect, se, effect / se if se > 1e-6 else 0.0, float(df), 1 - sse / (sst + 1e-10)])
            out = pd.DataFrame(rows, columns=[*by, "term", "effect", "se", "t", "df", "r2"])
            out["p"] = t_sf2(out["t"].to_numpy(float), np.maximum(out["df"].to_numpy(float), 1)) if len(out) else []
            yield out

    return run


def fit_linear(
    frame: DataFrame, design: Sequence[str], target: str, by: Sequence[str], alpha: float = 0.0, contrasts: dict[str, str] | None = None
) -> DataFrame:
    """by..., term, effect, se, t, df, r2, p of least squares (or ridge with alpha) for each group.

    Terms are the design's columns, or contrasts such as "a - b" or "2*a + b". t is 0 where the error
    is 1e-6 or less; df is n less the rank.
    """
    sums = cross_products(frame, design, target, by)
    weights = {k: parse_contrast(v, design) for k, v in (contrasts or {}).items()} or None
    types = dict(sums.dtypes)
    schema = ", ".join([*(f"{b} {types[b]}" for b in by), "term string", *(f"{c} double" for c in ("effect", "se", "t", "df", "r2", "p"))])
    return sums.mapInPandas(_solver(list(design), list(by), alpha, weights), schema)


def parse_contrast(text: str, names: Sequence[str]) -> np.ndarray:
    """Weights of a contrast: terms with + and -, each a name or number * name; repeated names add up."""
    out = np.zeros(len(names))
    sign = 1.0
    for piece in text.replace("-", " - ").replace("+", " + ").split():
        if piece in "+-":
            sign = 1.0 if piece == "+" else -1.0
            continue
        number, _, name = piece.rpartition("*")
        if name not in names:
            raise ValueError(f"contrast term {piece!r} names no column of {list(names)}")
        out[list(names).index(name)] += sign * (float(number) if number else 1.0)
        sign = 1.0
    return out


def ridge_cv(frame: DataFrame, design: Sequence[str], target: str, fold: str, alphas: Sequence[float]) -> DataFrame:
    """fold, alpha, r2: each fold predicted by a ridge fit on the others.

    Cross products are summed once for each fold; a training set's are the total less the fold's, so
    no fold is read twice and no row moves.
    """
    sums = cross_products(frame, design, target, [fold])
    k = len(design)

    def run(table: pd.DataFrame) -> pd.DataFrame:
        grams, xys = np.stack([_gram(x, k) for x in table["xx"]]), np.stack(table["xy"].to_list())
        rows = []
        for i, f in enumerate(table[fold]):
            gram, xy = grams.sum(0) - grams[i], xys.sum(0) - xys[i]
            n, sy, yy = float(table["n"].iloc[i]), float(table["sy"].iloc[i]), float(table["yy"].iloc[i])
            for a in alphas:
                beta = np.linalg.solve(gram + a * np.eye(k), xy)
                sse, sst = yy - 2 * beta @ xys[i] + beta @ grams[i] @ beta, yy - sy * sy / n
                rows.append((f, float(a), 1 - sse / sst if sst > 0 else 0.0))
        return pd.DataFrame(rows, columns=[fold, "alpha", "r2"])

    kind = dict(sums.dtypes)[fold]
    return sums.groupBy().applyInPandas(run, f"{fold} {kind}, alpha double, r2 double")  # a row a fold


def best_alpha(scores: DataFrame) -> DataFrame:
    """The alpha of the best mean score, the larger one of equals."""
    mean = scores.groupBy("alpha").agg(F.avg("r2").alias("r2"))
    return mean.agg(F.max(F.struct(F.round("r2", 12).alias("r2"), "alpha")).alias("b")).select(F.col("b.alpha").alias("alpha"), F.col("b.r2").alias("r2"))


def anova_p(f: np.ndarray, dfb: np.ndarray, dfw: np.ndarray) -> np.ndarray:
    return f_sf(f, dfb, dfw)


def vif(corr: DataFrame, columns: Sequence[str]) -> list[float | None]:
    """Variance inflation of each column from the correlations i, j, r of a few design columns."""
    k = len(columns)
    m = np.eye(k)
    for r in corr.collect():  # k * (k - 1) / 2 rows
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["r"]
    return [1.0] if k == 1 else [None] * k if np.linalg.matrix_rank(m) < k else np.diag(np.linalg.inv(m)).tolist()


def clean_columns(corr: DataFrame, columns: Sequence[str], limit: float) -> list[str]:
    """The columns that stay when, of each pair with |r| >= limit in order, the later one goes."""
    r = {(row["i"], row["j"]): abs(row["r"]) for row in corr.collect()}
    gone: set[int] = set()
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            if i not in gone and j not in gone and r.get((i, j), 0.0) >= limit:
                gone.add(j)
    return [c for k, c in enumerate(columns) if k not in gone]


def with_fit(frame: DataFrame, fit: DataFrame, design: Sequence[str], target: str, by: Sequence[str]) -> DataFrame:
    """frame with predicted and residual from the terms of fit_linear (or ridge_by_fold's, by fold)."""
    wide = fit.groupBy(*by).pivot("term", list(design)).agg(F.first("effect"))
    named = sent(keep(wide.select(*by, *[F.col(d).alias(f"beta_{d}") for d in design]), "fit"))  # a row a group: rows stay where they are
    predicted = sum((F.col(d) * F.col(f"beta_{d}") for d in design), F.lit(0.0))
    joined = frame.join(named, list(by)).withColumn("predicted", predicted).drop(*[f"beta_{d}" for d in design])
    return joined.withColumn("residual", F.col(target) - F.col("predicted"))


def _fold_solver(design: Sequence[str], by: Sequence[str], fold: str, alphas: Sequence[float], best_only: bool):
    k = len(design)

    def run(table: pd.DataFrame) -> pd.DataFrame:
        grams, xys = np.stack([_gram(x, k) for x in table["xx"]]), np.stack(table["xy"].to_list())
        n, sy, yy = (table[c].to_numpy(float) for c in ("n", "sy", "yy"))
        r2, betas = np.zeros((len(alphas), len(table))), {}
        for a, alpha in enumerate(alphas):
            for i in range(len(table)):
                beta = np.linalg.solve(grams.sum(0) - grams[i] + alpha * np.eye(k), xys.sum(0) - xys[i])
                sse, sst = yy[i] - 2 * beta @ xys[i] + beta @ grams[i] @ beta, yy[i] - sy[i] ** 2 / n[i]
                r2[a, i] = 1 - sse / sst if sst > 0 else 0.0
                betas[a, i] = beta
        best = int(np.argmax(r2.mean(axis=1).round(12) + 1e-13 * np.arange(len(alphas))))
        keys = [table[b].iloc[0] for b in by]
        if best_only:
            return pd.DataFrame([[*keys, float(alphas[best]), float(r2[best].mean())]], columns=[*by, "alpha", "r2"])
        rows = [[*keys, f, d, float(betas[best, i][j])] for i, f in enumerate(table[fold]) for j, d in enumerate(design)]
        return pd.DataFrame(rows, columns=[*by, fold, "term", "effect"])

    return run


def ridge_cv_by_target(frame: DataFrame, design: Sequence[str], target: str, fold: str, by: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """by..., alpha, r2: each target's own best alpha over the folds, the larger of equals."""
    sums = cross_products(frame, design, target, [*by, fold])
    kinds = dict(sums.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), "alpha double", "r2 double"])
    return sums.groupBy(*by).applyInPandas(_fold_solver(list(design), list(by), fold, list(alphas), True), schema)


def ridge_by_fold(frame: DataFrame, design: Sequence[str], target: str, fold: str, by: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """by..., fold, term, effect: trained without the fold, at the best alpha; with_fit gives held-out predictions."""
    sums = cross_products(frame, design, target, [*by, fold])
    kinds = dict(sums.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), f"{fold} {kinds[fold]}", "term string", "effect double"])
    return sums.groupBy(*by).applyInPandas(_fold_solver(list(design), list(by), fold, list(alphas), False), schema)
