"""Exponentially weighted means and deviations of whole series, O(rows).

All figures of a call are made in one pass over a series in time order, so a panel needs one exchange and one sort, however many spans there are.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidepanel.core.frames import KEY, TIME
from tidepanel.core.series import per_series


def mean(x: np.ndarray, span: float | None = None, alpha: float | None = None) -> np.ndarray:
    """Adjusted mean; weights decay over missing values, which keep the value before them."""
    return pd.Series(x).ewm(span=span, alpha=alpha).mean().to_numpy()


def recursive(x: np.ndarray, span: float) -> np.ndarray:
    """y = a x + (1-a) y_prev over the known values, seeded with the first of them."""
    return pd.Series(x).ewm(span=span, adjust=False, ignore_na=True).mean().to_numpy()


def deviation(x: np.ndarray, span: float) -> np.ndarray:
    """Adjusted, bias-corrected deviation; missing below two values."""
    return pd.Series(x).ewm(span=span).std().to_numpy()


def _each(df: DataFrame, jobs: dict[str, tuple[str, float]], make, key, time) -> DataFrame:
    columns = list(dict.fromkeys(x for x, _ in jobs.values()))
    plan = [(columns.index(x), s) for x, s in jobs.values()]
    return per_series(df, columns, list(jobs), lambda *x: [make(x[i], s) for i, s in plan], key, time)


def ewm_mean(df: DataFrame, jobs: dict[str, tuple[str, float]], key=KEY, time=TIME, by_alpha=False) -> DataFrame:
    """Adjusted EWM means: out -> (column, span). Weights decay over null rows too, which keep the value before them."""
    return _each(df, jobs, (lambda x, a: mean(x, alpha=a)) if by_alpha else mean, key, time)


def ewm_recursive(df: DataFrame, jobs: dict[str, tuple[str, float]], key=KEY, time=TIME) -> DataFrame:
    """Unadjusted y = a x + (1-a) y_prev over the non-null rows, seeded with the first of them; null rows keep the value."""
    return _each(df, jobs, recursive, key, time)


def ewm_std(df: DataFrame, jobs: dict[str, tuple[str, float]], key=KEY, time=TIME) -> DataFrame:
    """Adjusted, bias-corrected EWM deviations: out -> (column, span); null below two values."""
    return _each(df, jobs, deviation, key, time)
