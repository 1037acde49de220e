"""Weighted Gram sums: the only full pass over rows that any linear model here needs.

One grouped aggregate per model produces X'WX, X'Wy, y'Wy for every key at once; all
sums combine map-side, so a key holding most of the rows costs no more than others.
Solvers then see one small row per key.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def gram_columns(xs: list[Column], y: Column, w: Column | None = None, prefix: str = "") -> list[Column]:
    """Aggregates n, sw, xx (upper triangle, row major), xy and yy."""
    w = w if w is not None else F.lit(1.0)
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    return [F.count(F.lit(1)).alias(f"{prefix}n"), F.sum(w).alias(f"{prefix}sw"),
            F.array(*[F.sum(w * xs[i] * xs[j]) for i, j in pairs]).alias(f"{prefix}xx"),
            F.array(*[F.sum(w * x * y) for x in xs]).alias(f"{prefix}xy"), F.sum(w * y * y).alias(f"{prefix}yy")]


def gram(df: DataFrame, keys: list[str], xs: list[str], y: str, weight: str | None = None, intercept: bool = True) -> DataFrame:
    """One row per key; with ``intercept`` the first column of X is constant one."""
    cols = ([F.lit(1.0)] if intercept else []) + [F.col(x) for x in xs]
    d = df.where(" and ".join(f"`{c}` is not null" for c in [*xs, y]))
    return d.groupBy(*keys).agg(*gram_columns(cols, F.col(y), F.col(weight) if weight else None))


def square(upper) -> np.ndarray:
    """Symmetric matrix from its upper triangle."""
    upper = np.asarray(upper, float)
    d = int((np.sqrt(8 * len(upper) + 1) - 1) / 2)
    m = np.zeros((d, d))
    m[np.triu_indices(d)] = upper
    return m + np.triu(m, 1).T


def ridge(xx: np.ndarray, xy: np.ndarray, n: float, alpha: float) -> tuple[float, np.ndarray]:
    """Ridge with unpenalised intercept from sums whose first column is the constant."""
    mean, ybar = xx[0, 1:] / n, xy[0] / n
    sxx = xx[1:, 1:] - n * np.outer(mean, mean)
    sxy = xy[1:] - n * mean * ybar
    coef = np.linalg.solve(sxx + alpha * np.eye(len(mean)), sxy)
    return float(ybar - mean @ coef), coef


def per_row(df: DataFrame, fn: Callable[[dict], dict | list[dict] | None], schema: str) -> DataFrame:
    """Apply a small solver to every (already aggregated) row; no shuffle."""
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[dict] = []
            for r in pdf.to_dict("records"):
                res = fn(r)
                out += res if isinstance(res, list) else ([res] if res is not None else [])
            yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, schema)


def key_schema(df: DataFrame, keys: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"{k} {kinds[k]}" for k in keys)
