"""Gaussian mixtures of all keys at once.

Expectation and maximisation per key, every round one grouped aggregate of sufficient statistics (responsibilities, sums, cross products), which
combines before the shuffle; a key's parameters are one row. Components start as the k quantile ranges of the last feature, so a fit depends
neither on a seed nor on how rows are partitioned. Rows with a null feature take no part.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tidepanel.core.ordering import grouped_quantiles
from tidepanel.core.scratch import materialise
from tidepanel.functions.moments import argmax

ROUNDS, RIDGE, TOLERANCE = 20, 1e-6, 1e-3
TINY = 1e-14


def parameters(k: int, d: int) -> int:
    return (k - 1) + k * d + k * d * (d + 1) // 2


def _plus(items) -> str:
    return " + ".join(items) or "0"


def _maximise(rows: DataFrame, features: list[str], k: int, key: str) -> DataFrame:
    """Parameters per key from rows with responsibilities r0, r1, ... and log densities ``ll``: weights, means, covariances and
    the inverses of their Cholesky factors."""
    d = len(features)
    lower = [(i, j) for i in range(d) for j in range(i + 1)]
    x = [f"`{f}`" for f in features]
    sums = [F.expr("count(1) AS n"), F.expr("sum(ll) AS ll")]
    for c in range(k):
        sums += [F.expr(t) for t in (f"sum(r{c}) AS n{c}", *[f"sum(r{c} * {x[i]}) AS s{c}_{i}" for i in range(d)], *[f"sum(r{c} * {x[i]} * {x[j]}) AS s{c}_{i}_{j}" for i, j in lower])]
    each = lambda make: [t for c in range(k) for t in make(c)]
    p = rows.groupBy(key).agg(*sums)
    p = p.selectExpr("*", *each(lambda c: [f"n{c} / n AS w{c}", *[f"s{c}_{i} / (n{c} + {TINY}D) AS m{c}_{i}" for i in range(d)]]))
    p = p.selectExpr("*", *each(lambda c: [f"s{c}_{i}_{j} / (n{c} + {TINY}D) - m{c}_{i} * m{c}_{j} + {RIDGE if i == j else 0.0}D AS v{c}_{i}_{j}" for i, j in lower]))
    for i, j in lower:  # one entry of the factor after the other; the table has one row per key
        rest = lambda c, i=i, j=j: f"v{c}_{i}_{j} - ({_plus(f'l{c}_{i}_{h} * l{c}_{j}_{h}' for h in range(j))})"
        p = p.selectExpr("*", *[f"sqrt(greatest({rest(c)}, {TINY}D)) AS l{c}_{i}_{j}" if i == j else f"({rest(c)}) / l{c}_{j}_{j} AS l{c}_{i}_{j}" for c in range(k)])
    for i in range(d):
        own = [f"1 / l{c}_{i}_{i} AS i{c}_{i}_{i}" for c in range(k)]
        p = p.selectExpr("*", *own, *[f"-({_plus(f'l{c}_{i}_{h} * i{c}_{h}_{j}' for h in range(j, i))}) / l{c}_{i}_{i} AS i{c}_{i}_{j}" for c in range(k) for j in range(i)])
    return p.select(key, "n", "ll", *each(lambda c: [f"w{c}", *[f"m{c}_{i}" for i in range(d)], *[f"{a}{c}_{i}_{j}" for a in "vi" for i, j in lower]]))


def _expect(rows: DataFrame, fitted: DataFrame, features: list[str], k: int, key: str, keep: list[str]) -> DataFrame:
    """``keep`` with responsibilities r0, r1, ... and the log density of each row."""
    d = len(features)
    far = lambda c: _plus(f"power({_plus(f'i{c}_{i}_{h} * (`{features[h]}` - m{c}_{h})' for h in range(i + 1))}, 2)" for i in range(d))
    log = lambda c: f"ln(greatest(w{c}, 1e-300D)) + {_plus(f'ln(i{c}_{i}_{i})' for i in range(d))} - 0.5D * ({far(c)} + {d * math.log(2 * math.pi)!r}D) AS g{c}"
    names = [f"`{n}`" for n in keep]
    j = rows.join(fitted.drop("n", "ll"), key).selectExpr(*names, *[log(c) for c in range(k)])
    j = j.selectExpr("*", f"array_max(array({', '.join(f'g{c}' for c in range(k))})) AS top")
    j = j.selectExpr(*names, "top", *[f"exp(g{c} - top) AS e{c}" for c in range(k)])
    j = j.selectExpr("*", f"{_plus(f'e{c}' for c in range(k))} AS total")
    return j.selectExpr(*names, *[f"e{c} / total AS r{c}" for c in range(k)], "top + ln(total) AS ll")


def fit(df: DataFrame, features: list[str], k: int = 3, rounds: int = ROUNDS, key: str = "series") -> DataFrame:
    """One row of parameters per key, with the log likelihood ``ll`` under the parameters of the round before."""
    rows = materialise(df.select(key, *features).na.drop(subset=features), "mixture")
    last = features[-1]
    cuts = grouped_quantiles(rows, [key], last, {f"q{c}": c / k for c in range(1, k)}, stage=False).drop("n") if k > 1 else rows.select(key).distinct()
    part = _plus(f"cast(`{last}` > q{c} as int)" for c in range(1, k))
    start = rows.join(cuts, key).selectExpr(f"`{key}`", *[f"`{f}`" for f in features], *[f"CASE WHEN {part} = {c} THEN 1D ELSE 0D END AS r{c}" for c in range(k)], "0D AS ll")
    p = materialise(_maximise(start, features, k, key), "mixture")
    for _ in range(rounds):
        p = materialise(_maximise(_expect(rows, p, features, k, key, [key, *features]), features, k, key), "mixture")
    return p


def _order(fitted: DataFrame, k: int, d: int, key: str) -> DataFrame:
    """(key, order): components by total variance."""
    spread = [F.struct(F.expr(_plus(f"v{c}_{i}_{i}" for i in range(d))).alias("v"), F.lit(c).alias("c")) for c in range(k)]
    return fitted.select(key, F.transform(F.array_sort(F.array(*spread)), lambda s: s["c"]).alias("order"))


def probabilities(df: DataFrame, fitted: DataFrame, features: list[str], k: int = 3, key: str = "series", keep: tuple[str, ...] = ("date",)) -> DataFrame:
    """(key, keep, probs, regime): components of each key ordered by total variance."""
    e = _expect(df.na.drop(subset=features), fitted, features, k, key, [key, *keep])
    e = e.join(_order(fitted, k, len(features), key), key)
    raw = F.array(*[F.col(f"r{c}") for c in range(k)])
    return e.select(key, *keep, F.transform("order", lambda c: F.get(raw, c)).alias("probs")).withColumn("regime", argmax(F.col("probs")))


def criteria(df: DataFrame, fitted: DataFrame, features: list[str], k: int = 3, key: str = "series") -> DataFrame:
    """Per key and component: weight, mean, covariance (rows of the lower triangle), and the key's AIC and BIC.

    ``converged`` where the last round gained less than TOLERANCE a row.
    """
    d = len(features)
    lower = [(i, j) for i in range(d) for j in range(i + 1)]
    total = _expect(df.na.drop(subset=features), fitted, features, k, key, [key]).groupBy(key).agg(F.sum("ll").alias("log_likelihood"), F.count(F.lit(1)).alias("n_rows"))
    parts = F.array(*[F.struct(F.col(f"w{c}").alias("weight"), F.array(*[F.col(f"m{c}_{i}") for i in range(d)]).alias("mean"), F.array(*[F.col(f"v{c}_{i}_{j}") for i, j in lower]).alias("cov")) for c in range(k)])
    flat = fitted.select(key, F.col("ll").alias("before"), parts.alias("parts")).join(_order(fitted, k, d, key), key)
    flat = flat.select(key, "before", F.posexplode(F.transform("order", lambda c: F.get("parts", c))).alias("component", "p")).join(total, key)
    p = parameters(k, d)
    ll, n = F.col("log_likelihood"), F.col("n_rows")
    return flat.select(key, "component", "p.weight", "p.mean", "p.cov", F.lit(p).alias("n_params"), "n_rows", "log_likelihood", (2 * p - 2 * ll).alias("aic"), (p * F.log(n) - 2 * ll).alias("bic"),
                       (F.abs(ll - F.col("before")) < TOLERANCE * n).alias("converged"))
