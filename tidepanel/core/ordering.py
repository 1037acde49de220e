"""Exact ranks and quantiles of groups of any size.

The size of the largest group is counted first. Up to LIMIT rows a group is one window partition or one percentile aggregate: one exchange
and one sort for any number of ranks. Larger groups are never gathered: equal values are collapsed, all groups are laid out in one
range-partitioned order whose cut points Spark samples, and a value's place is its running count inside its range plus what a prefix sum
over the ranges puts before it. Both ways give the same figures.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.core.scratch import materialise

#: Rows of a group that one task orders.
LIMIT = 1_000_000


def _sizes(df: DataFrame, keys: list[str], value: str) -> tuple[int, int]:
    """Known values of the largest group, and of all."""
    row = df.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return int(row[0] or 0), int(row[1] or 0)


def largest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group."""
    return int(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0)


def positions(df: DataFrame, keys: list[str], value: str, limit: int = LIMIT) -> DataFrame:
    """(keys, value, cnt, below, n): rows equal to and strictly below each distinct value; ``df`` is read twice."""
    most, total = _sizes(df, keys, value)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    before = lambda w: F.coalesce(F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if most <= limit:
        group = [F.col(k) for k in keys] or [F.lit(0)]
        w = Window.partitionBy(*group)
        return counts.select(*keys, value, "cnt", F.sum("cnt").over(w).alias("n"), before(w.orderBy(value)).alias("below"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * total // limit))
    laid = counts.repartitionByRange(parts, *keys, value).sortWithinPartitions(*keys, value).withColumn("_part", F.spark_partition_id())
    laid = materialise(laid, "order")
    ranges = laid.groupBy(*keys, "_part").agg(F.sum("cnt").alias("cnt"))
    w = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)]))
    ranges = ranges.select(*keys, "_part", F.sum("cnt").over(w).alias("n"), before(w.orderBy("_part")).alias("_before"))
    inside = laid.withColumn("_in", before(Window.partitionBy(*keys, "_part").orderBy(value)))
    return inside.join(ranges, [*keys, "_part"]).select(*keys, value, "cnt", "n", (F.col("_before") + F.col("_in")).alias("below"))


def grouped_rank(df: DataFrame, keys: list[str], value: str, out: str, method: str = "average",
                 pct: bool = True, base: DataFrame | None = None, limit: int = LIMIT, most: int | None = None) -> DataFrame:
    """Add the ascending rank of ``value`` within ``keys``; null stays null.

    The input is read twice (sizes, ranks), so it is written once to keep the plan that made it from running again. A
    caller that already holds a stored table passes it as ``base`` (same keys and values, any columns). One that knows that no
    group has more than ``most`` rows passes that: up to the limit nothing is counted or written.
    """
    if most is None or most > limit:
        if base is None:
            df = base = materialise(df, "rank")
        most = _sizes(base, keys, value)[0]
    if most <= limit:
        w = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)]))
        ranked = w.orderBy(F.col(value).asc_nulls_last())
        low, n = F.rank().over(ranked).cast("double"), F.count(value).over(w)
        # rows of equal value are the range frame of the current row: the order of the rank serves it too
        ties = F.count(value).over(ranked.rangeBetween(Window.currentRow, Window.currentRow)) if method != "min" else F.lit(1)
        rank = {"average": low + (ties - 1) / 2.0, "min": low, "max": low + ties - 1}[method]
        return df.withColumn(out, F.when(F.col(value).isNotNull(), rank / n if pct else rank))
    pos = positions(base, keys, value, limit)
    rank = {"average": F.col("below") + (F.col("cnt") + 1) / 2.0,
            "min": F.col("below") + 1.0,
            "max": (F.col("below") + F.col("cnt")).cast("double")}[method]
    pos = pos.select(*keys, value, (rank / F.col("n") if pct else rank).alias(out))
    return df.join(pos, [*keys, value], "left")


def _at(p: float) -> Column:
    return F.lit(p) * (F.col("n") - 1)


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], stage: bool = True, limit: int = LIMIT) -> DataFrame:
    """(keys, n, one column per name): linearly interpolated exact quantiles of each group with a known value."""
    df = df.select(*keys, value)
    if stage:
        df = materialise(df, "quantile")
    if _sizes(df, keys, value)[0] <= limit:
        known = df.where(F.col(value).isNotNull())
        q = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()])).alias("_q"))
        return q.select(*keys, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])
    near = positions(df, keys, value, limit)
    wanted = F.lit(False)
    for p in probs.values():
        wanted = wanted | ((F.col("below") <= F.ceil(_at(p))) & (F.col("below") + F.col("cnt") > F.floor(_at(p))))
    near = near.where(wanted)
    aggs = []
    for name, p in probs.items():
        holds = lambda place: F.max(F.when((F.col("below") <= place) & (F.col("below") + F.col("cnt") > place), F.col(value)))
        lo, hi = holds(F.floor(_at(p))), holds(F.ceil(_at(p)))
        aggs.append((lo + (hi - lo) * F.max(_at(p) - F.floor(_at(p)))).alias(name))
    return near.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
