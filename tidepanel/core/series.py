"""Figures of whole series: one exchange and one sort by key, then arrays in time order.

For what plain windows can only do with a sort per figure or by going through a frame again for every row. A series is bounded by
its calendar and is held by one task; any number of series follow each other through a task.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidepanel.core.frames import KEY, TIME


def per_series(df: DataFrame, columns: list[str], outs: list[str], fn: Callable[..., list[np.ndarray]], key=KEY, time=TIME) -> DataFrame:
    """Add the double columns ``outs``, which ``fn`` makes of the ``columns`` of each series as float arrays in time order; nan stands for null."""
    keys = [key] if isinstance(key, str) else list(key)

    def one(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(time, "ascending")], null_placement="at_start"))
        x = [table.column(c).combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]
        for name, values in zip(outs, fn(*x)):
            table = table.append_column(name, pa.array(values, pa.float64(), mask=np.isnan(values)))
        return table

    df = df.drop(*outs)
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{o}` double" for o in outs])
    return df.groupBy(*[F.col(k) for k in keys]).applyInArrow(one, fields)


def full_windows(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose last n values are all known, and those values, one row per place."""
    if len(x) < n:
        return np.zeros(0, np.int64), np.zeros((0, n))
    w = np.lib.stride_tricks.sliding_window_view(x, n)
    seen = np.concatenate([[0], np.cumsum(~np.isnan(x))])
    at = np.flatnonzero(seen[n:] - seen[:-n] == n)
    return at + n - 1, w[at]


def placed(size: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.full(size, np.nan)
    out[at] = values
    return out


def centred(w: np.ndarray) -> np.ndarray:
    """Rows less their mean; exactly zero where all values are equal."""
    w = w - w[:, :1]
    return w - w.mean(axis=1, keepdims=True)
