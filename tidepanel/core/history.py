"""Ranks of a value among everything known at its time.

For each row: how many rows of its group are not later, how many of those are smaller, how many equal. Counted over (time block x
value range): within a time block, within a value range against earlier blocks, and from the block-by-range counts for all the
rest. A task holds one block, one range or one group's counts, never a whole large group; each count is sorting and binary search,
n log n. Later rows never enter, so appending rows changes no past figure.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.core.scratch import materialise

#: Distinct (time, value) pairs of a group that one task takes; most blocks and ranges of a group, beyond which they grow.
BLOCK, PARTS = 1 << 17, 512


def dominance(time: np.ndarray, value: np.ndarray, weight: np.ndarray, strict: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight of the rows not later (``strict``: earlier) that are smaller, that are equal, and of all of them.

    The rows up to a time are, by the binary digits of their number, a few aligned runs in time order; sorted by value within the
    runs of every length, each run is one binary search.
    """
    n = len(time)
    order = np.argsort(time, kind="stable")
    t, w = time[order], weight[order]
    _, rank = np.unique(value[order], return_inverse=True)
    upto = np.searchsorted(t, t, "left" if strict else "right")
    below, equal = np.zeros(n, weight.dtype), np.zeros(n, weight.dtype)
    place = np.arange(n)
    for k in range(max(1, int(n).bit_length())):
        use = np.flatnonzero((upto >> k) & 1)
        if not len(use):
            continue
        code = (place >> k) * (n + 1) + rank
        by = np.argsort(code, kind="stable")
        code, total = code[by], np.concatenate([[0], np.cumsum(w[by])])
        run = (upto[use] >> k) - 1  # the run of 2**k rows that ends where this digit's share ends
        lo, hi = np.searchsorted(code, run * (n + 1) + rank[use], "left"), np.searchsorted(code, run * (n + 1) + rank[use], "right")
        below[use] += total[lo] - total[run << k]
        equal[use] += total[hi] - total[lo]
    known = np.concatenate([[0], np.cumsum(w)])[upto]
    out = np.empty((3, n), weight.dtype)
    out[:, order] = below, equal, known
    return out[0], out[1], out[2]


def _counted(df: DataFrame, groups: list[str], time: str, value: str, names: list[str], strict: bool = False) -> DataFrame:
    """Adds below, equal and known within each group as ``names``."""
    def run(table: pa.Table) -> pa.Table:
        got = dominance(table.column(time).to_numpy(), table.column(value).to_numpy(), table.column("_w").to_numpy(), strict)
        for name, values in zip(names, got, strict=True):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*groups).applyInArrow(run, f"{fields}, {', '.join(f'{n} long' for n in names)}")


def expanding_positions(df: DataFrame, keys: list[str], time: str, value: str, block: int = BLOCK) -> DataFrame:
    """(keys, time, value, below, equal, n) of each distinct row: smaller, equal (itself included) and all rows known at its time.

    Rows of one time know each other. Null values and times have no row; NaN is the largest value.
    """
    d = df.select(*keys, F.col(time).alias("_time"), F.col(value).cast("double").alias("_v")).where("_time is not null and _v is not null")
    kind = d.schema["_time"].dataType.simpleString()
    at = F.unix_micros("_time") if kind == "timestamp" else F.unix_date("_time").cast("long") if kind == "date" else F.col("_time").cast("long")
    d = materialise(d.withColumn("_t", at).groupBy(*keys, "_time", "_t", "_v").agg(F.count(F.lit(1)).alias("_w")), "history")
    most = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = min(PARTS, -(-most // block))
    if parts <= 1:
        out = _counted(d, keys, "_t", "_v", ["below", "equal", "n"])
        return out.select(*keys, F.col("_time").alias(time), F.col("_v").alias(value), "below", "equal", "n")
    cuts = [i / parts for i in range(1, parts)]
    bounds = d.groupBy(*keys).agg(F.percentile_approx("_t", F.array(*map(F.lit, cuts)), F.lit(20 * parts)).alias("_ta"), F.percentile_approx("_v", F.array(*map(F.lit, cuts)), F.lit(20 * parts)).alias("_va"))
    d = d.join(bounds, keys) if keys else d.withColumns({c: bounds.select(c).scalar() for c in ("_ta", "_va")})
    d = d.withColumns({"_tb": F.size(F.filter("_ta", lambda c: c < F.col("_t"))), "_vr": F.size(F.filter("_va", lambda c: c < F.col("_v")))}).drop("_ta", "_va")
    d = materialise(d, "history")
    cells = d.groupBy(*keys, "_tb", "_vr").agg(F.sum("_w").alias("_w"))
    cells = _counted(cells.withColumn("_late", F.col("_tb")).withColumn("_v", F.col("_vr").cast("double")), keys, "_late", "_v", ["_cb", "_ce", "_cn"], strict=True).drop("_w", "_late", "_v", "_ce")
    inside = _counted(d, [*keys, "_tb"], "_t", "_v", ["_b1", "_e1", "_n1"])
    both = _counted(inside, [*keys, "_vr"], "_tb", "_v", ["_b2", "_e2", "_n2"], strict=True)
    c = F.col
    return both.join(cells, [*keys, "_tb", "_vr"]).select(
        *keys, c("_time").alias(time), c("_v").alias(value), (c("_b1") + c("_b2") + c("_cb")).alias("below"), (c("_e1") + c("_e2")).alias("equal"), (c("_n1") + c("_cn")).alias("n"))


def expanding_rank(df: DataFrame, keys: list[str], time: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Average percentile rank of each value among the rows of its group known at its time; null stays null."""
    df = materialise(df, "history")
    p = expanding_positions(df, keys, time, value, block).select(*keys, time, value, ((F.col("below") + (F.col("equal") + 1) / 2.0) / F.col("n")).alias(out))
    return df.join(p, [*keys, time, value], "left")


def expanding_uniform(df: DataFrame, time: str, cols: list[str], keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Adds ``<col>_uniform``: the average rank among the rows known at its time, mapped to [0, 1]; null for the only row."""
    df, keys = materialise(df, "history"), keys or []
    for col in cols:
        p = expanding_positions(df, keys, time, col, block)
        u = (F.col("below") + (F.col("equal") - 1) / 2.0) / F.nullif(F.col("n") - 1, F.lit(0))
        df = df.join(p.select(*keys, time, col, u.alias(f"{col}_uniform")), [*keys, time, col], "left")
    return df


def expanding_standard(df: DataFrame, time: str, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """Adds ``<col>_standard`` from mean and population deviation of the rows known at its time: sums per time, then a running sum over times."""
    df, keys = materialise(df, "history"), keys or []
    sums = [f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in cols for n, f in (("n", F.count), ("s", F.sum), ("q", lambda x: F.sum(x * x)))]
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    run = df.groupBy(*keys, time).agg(*sums)
    run = run.select(*keys, time, *[F.sum(f"_{n}_{c}").over(w).alias(f"_{n}_{c}") for c in cols for n in "nsq"])
    df = df.join(run, [*keys, time])
    out = {}
    for c in cols:
        n, s, q = (F.col(f"_{k}_{c}") for k in "nsq")
        spread = F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
        out[f"{c}_standard"] = (F.col(c) - s / n) / F.nullif(spread, F.lit(0.0))
    return df.withColumns(out).drop(*[f"_{n}_{c}" for c in cols for n in "nsq"])
