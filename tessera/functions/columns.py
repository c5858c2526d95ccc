"""Column expressions that the operators share; all are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    """Rounded to six digits, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def safe_div(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b, and `otherwise` where b is 0."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(otherwise).cast("double"))


def fisher_r_to_z(r: Column) -> Column:
    return F.atanh(r)


def fisher_z_to_r(z: Column) -> Column:
    return F.tanh(z)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_mean(a: Column) -> Column:
    return array_sum(a) / F.size(a)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_center(a: Column) -> Column:
    return let(array_mean(a), lambda m: F.transform(a, lambda x: x - m))


def array_std(a: Column, ddof: int = 0) -> Column:
    squares = let(array_mean(a), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))
    return F.sqrt(squares / (F.size(a) - ddof))


def moments(x: str, y: str) -> list[Column]:
    """Aggregates that regressions and correlations need: n, sx, sy, sxx, syy, sxy over complete pairs."""
    a, b = F.col(x), F.col(y)
    both = a.isNotNull() & b.isNotNull()
    parts = {"n": F.lit(1.0), "sx": a, "sy": b, "sxx": a * a, "syy": b * b, "sxy": a * b}
    return [F.sum(F.when(both, e)).alias(k) for k, e in parts.items()]


def corr_of_moments(otherwise: float | None = 0.0) -> Column:
    """Pearson's r from the columns of moments(); `otherwise` for a constant side."""
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = n * F.col("sxx") - sx * sx, n * F.col("syy") - sy * sy
    return F.when((vx > 1e-12) & (vy > 1e-12), (n * F.col("sxy") - sx * sy) / F.sqrt(F.greatest(vx * vy, F.lit(1e-300)))).otherwise(
        F.lit(otherwise).cast("double")
    )


def legendre(x: Column, order: int) -> list[Column]:
    """P_0 to P_order at x by Bonnet's recurrence."""
    out = [F.lit(1.0), x]
    for k in range(1, order):
        out.append(((2 * k + 1) * x * out[k] - k * out[k - 1]) / (k + 1))
    return out[: order + 1]
