"""Top-k, tails, and set algebra over symbols, dates and feature lists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """k rows of a total order: per-task heaps merged by TakeOrderedAndProject."""
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, keys: list[str], k: int, order: list[Column], salts: int = 32) -> DataFrame:
    """k first rows per group. Groups are cut into salted parts first, so a hot group is
    reduced to salts*k rows before one task orders it; no row of the true top k is lost."""
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    d = d.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
    return d.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k).drop("_salt", "_r")


def tail(df: DataFrame, n: int, key="symbol", time="date") -> DataFrame:
    """Last n rows per key (a key's history is calendar-bounded)."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc()))
    return df.withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def stack(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_dates(frames: list[DataFrame], time="date") -> DataFrame:
    return stack([f.select(time).distinct() for f in frames]).distinct()


def intersect_dates(frames: list[DataFrame], time="date") -> DataFrame:
    out = frames[0].select(time)
    for f in frames[1:]:
        out = out.intersect(f.select(time))
    return out


def symbol_overlap(frames: list[DataFrame], key="symbol") -> DataFrame:
    """Symbols with the number of datasets that hold them and whether all do."""
    names = stack([f.select(key).distinct() for f in frames])
    g = names.groupBy(key).agg(F.count(F.lit(1)).alias("datasets"))
    return g.withColumn("common", F.col("datasets") == len(frames))


def set_change(before: Column, after: Column) -> dict[str, Column]:
    """Added, removed, symmetric difference size and Jaccard similarity of two arrays."""
    union = F.size(F.array_union(before, after))
    return {"added": F.array_sort(F.array_except(after, before)), "removed": F.array_sort(F.array_except(before, after)),
            "n_changed": F.size(F.array_except(after, before)) + F.size(F.array_except(before, after)),
            "jaccard": F.when(union > 0, F.size(F.array_intersect(before, after)) / union).otherwise(0.0)}
