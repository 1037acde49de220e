"""Bias-corrected moments, p-values in closed form and probability-array helpers."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from tidepanel.core.frames import c, div


def _over(e: Column, w: WindowSpec | None) -> Column:
    return e.over(w) if w is not None else e


def skew_g1(x, w: WindowSpec | None = None) -> Column:
    """Sample skewness with the small-sample factor; null below 3 values or zero spread."""
    n = _over(F.count(c(x)), w).cast("double")
    g = _over(F.skewness(c(x)), w)
    return F.when(n >= 3, g * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_g2(x, w: WindowSpec | None = None) -> Column:
    """Sample excess kurtosis with the small-sample factor; null below 4 values or zero spread."""
    n = _over(F.count(c(x)), w).cast("double")
    g = _over(F.kurtosis(c(x)), w)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


def window_moments(df: DataFrame, x: str, frames: dict[str, WindowSpec]) -> DataFrame:
    """Bias-corrected rolling skewness and kurtosis (<tag>_skew, <tag>_kurt) from four plain power sums per frame.

    Re-evaluating Spark's central-moment aggregates for every frame costs several times
    more. Frames are summed afresh, so nothing accumulates; meant for return-like values
    whose mean is not far larger than their spread. Sums become columns first: a window
    expression repeated inside a formula would be evaluated once per mention.
    """
    v = F.col(x)
    sums = {}
    for tag, w in frames.items():
        sums[f"_{tag}n"] = F.count(v).over(w).cast("double")
        sums |= {f"_{tag}{k}": F.sum(e).over(w) for k, e in enumerate((v, v * v, v * v * v, v * v * v * v), 1)}
    df = df.withColumns(sums)
    central = {}
    for tag in frames:
        n, s1, s2, s3, s4 = (F.col(f"_{tag}{k}") for k in ("n", 1, 2, 3, 4))
        m = s1 / F.nullif(n, F.lit(0.0))
        central[f"_{tag}m2"] = F.when(s2 / n - m * m > 1e-14 * (s2 / n), s2 / n - m * m)
        central[f"_{tag}m3"] = s3 / n - 3 * m * s2 / n + 2 * m * m * m
        central[f"_{tag}m4"] = s4 / n - 4 * m * s3 / n + 6 * m * m * s2 / n - 3 * m * m * m * m
    df = df.withColumns({k: F.when(F.col(k.rsplit("m", 1)[0] + "n") > 0, e) for k, e in central.items()})
    out = {}
    for tag in frames:
        n, m2, m3, m4 = (F.col(f"_{tag}{k}") for k in ("n", "m2", "m3", "m4"))
        out[f"{tag}_skew"] = F.when(n >= 3, m3 / (m2 * F.sqrt(m2)) * F.sqrt(n * (n - 1)) / (n - 2))
        out[f"{tag}_kurt"] = F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6))
    return df.withColumns(out).drop(*sums, *central)


def f_tail_df2(f: Column, d2: Column) -> Column:
    """P(F > f) for 2 and d2 degrees of freedom."""
    return F.pow(1 + 2 * f / d2, -d2 / 2)


def chi2_tail_even(x: Column, dof: int) -> Column:
    """P(chi2 > x) for an even number of degrees of freedom."""
    terms = [F.pow(x / 2, F.lit(float(k))) / math.factorial(k) for k in range(dof // 2)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.exp(-x / 2) * total


def kolmogorov_tail(x: Column, terms: int = 100) -> Column:
    """Kolmogorov distribution tail, 2 * sum (-1)^(k-1) exp(-2 k^2 x^2), clipped to [0, 1]."""
    ks = F.sequence(F.lit(1), F.lit(terms))
    s = F.aggregate(
        ks, F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * 2.0 * F.exp(-2.0 * k * k * x * x))
    return F.when(x <= 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def array_mean(a: Column) -> Column:
    return div(array_sum(a), F.size(a).cast("double"))


def quad_form(x: Column, m: Column) -> Column:
    """x' M x for a vector and an array-of-arrays matrix."""
    return dot(x, F.transform(m, lambda row: dot(row, x)))


def entropy(p: Column) -> Column:
    return -array_sum(F.transform(p, lambda v: v * F.log(v + 1e-8)))


def argmax(p: Column) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def normalised(p: Column) -> Column:
    total = array_sum(p)
    return F.when(total > 0, F.transform(p, lambda v: v / total))
