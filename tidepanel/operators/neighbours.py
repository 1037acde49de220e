"""Nearest complete rows for rows that miss a value.

Standardised features are projected on a few fixed unit directions; each direction is cut into buckets of about equal size. A row that
misses the target looks at its own bucket and those beside it, keeps the k nearest of each, and then of all directions. A projection never
lengthens a distance, so the k nearest are proven as soon as the k-th is no farther than the edge of what was looked
at. Rows without that proof look once more, along one direction and as far as the k-th found so far, which proves them all; only
buckets that they ask for are sent again.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.core.frames import attach
from tidepanel.core.scratch import materialise

#: Directions, complete rows of a bucket, times that unproven rows look again.
DIRECTIONS, BUCKET, ROUNDS = 3, 20_000, 1
#: Rows of a batch of found neighbours: Spark 4.1 fails where it cuts batches of grouped results to the session's byte limit itself.
ROWS = 16_384


def directions(d: int, n: int = DIRECTIONS, seed: int = 7) -> np.ndarray:
    """Unit vectors; a single feature has one direction."""
    if d == 1:
        return np.ones((1, 1))
    v = np.random.Generator(np.random.PCG64(seed)).normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _dealt(rows: DataFrame, zs: list[str], axes: np.ndarray, cuts: list[np.ndarray], reach: int, keep: list[str], only: tuple[int, list[int]] | None = None) -> DataFrame:
    """One row per direction and bucket in reach; ``gap`` is the distance from the row to the edge of its reach.

    ``only`` names a direction and the buckets of it that are wanted.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(z).to_numpy(zero_copy_only=False) for z in zs])
            for axis, (way, cut) in enumerate(zip(axes, cuts, strict=True)):
                if only and axis != only[0]:
                    continue
                p = x @ way
                own = np.searchsorted(cut, p, "left")
                edge = np.concatenate([[-np.inf], cut, [np.inf]])
                lo, hi = np.maximum(own - reach, 0), np.minimum(own + reach, len(cut))
                gap = np.minimum(p - edge[lo], edge[hi + 1] - p)
                for bucket in range(-reach, reach + 1):
                    ok = np.flatnonzero((own + bucket >= 0) & (own + bucket <= len(cut)) & (np.isin(own + bucket, only[1]) if only else True))
                    if len(ok):
                        part = b.take(pa.array(ok))
                        yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(np.full(len(ok), axis), pa.int32()), pa.array((own + bucket)[ok]), pa.array(gap[ok])],
                                                         [*keep, "axis", "bucket", "gap"])
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep).mapInArrow(run, f"{fields}, axis int, bucket long, gap double")


def _reaching(rows: DataFrame, zs: list[str], axes: np.ndarray, cuts: list[np.ndarray]) -> DataFrame:
    """One row per direction with the first and last bucket that hold all within ``bound`` of the row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(z).to_numpy(zero_copy_only=False) for z in zs])
            for axis, (way, cut) in enumerate(zip(axes, cuts, strict=True)):
                p = x @ way
                far = _wide(b.column("bound").to_numpy(), p)
                ends = [pa.array(np.searchsorted(cut, e, "left")) for e in (p - far, p + far)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ["id", *zs, "bound"]], pa.array(np.full(len(p), axis), pa.int32()), *ends], ["id", *zs, "bound", "axis", "lo", "hi"])
    return rows.select("id", *zs, "bound").mapInArrow(run, "id long, " + ", ".join(f"`{z}` double" for z in zs) + ", bound double, axis int, lo long, hi long")


def _wide(bound: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Bounds with room for the rounding of projections."""
    return bound * (1 + 1e-9) + 1e-12 * (1 + np.abs(p))


def nearest(asking: DataFrame, complete: DataFrame, zs: list[str], order: list[str], k: int, bucket: int = BUCKET, rounds: int = ROUNDS) -> DataFrame:
    """(id, near, proven) for ``asking`` (id, zs): the k nearest of ``complete`` (zs, order, _y) as structs (distance, order, y), nearest first.

    Ties go to the smaller ``order``. Of rows alike in all features only the k first by ``order`` can be among the nearest, so large
    groups of equal rows do not meet in a bucket.
    """
    # Spark takes the first k of a group in each task before its rows are sent, so a large group is no hot key
    alike = F.row_number().over(Window.partitionBy(*zs).orderBy(*order))
    complete = materialise(complete.withColumn("_r", alike).where(F.col("_r") <= k).select(*zs, *order, "_y"), "complete")
    n, axes = complete.count(), directions(len(zs))
    parts = max(1, -(-n // bucket))
    at = [i / parts for i in range(1, parts)]
    if at:
        projected = [sum((F.col(z) * float(v) for z, v in zip(zs[1:], way[1:], strict=True)), F.col(zs[0]) * float(way[0])) for way in axes]
        row = complete.agg(*[F.percentile_approx(p, F.array(*map(F.lit, at)), F.lit(20 * parts)).alias(f"c{i}") for i, p in enumerate(projected)]).first()
        cuts = [np.unique(np.array(row[f"c{i}"], float)) for i in range(len(axes))]
    else:
        cuts = [np.zeros(0) for _ in axes]
    kinds = {f.name: f.dataType.simpleString() for f in complete.schema.fields}
    result = "id long, distance double, " + ", ".join(f"`{c}` {kinds[c]}" for c in order) + ", _y double, gap double"
    dealt = _dealt(complete, zs, axes, cuts, 0, [*zs, *order, "_y"]).drop("gap")

    def closest(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([(c, "ascending") for c in order])
        x, y = (np.column_stack([t.column(z).to_numpy() for z in zs]) for t in (left, right))
        rows, which, far = [], [], []
        bounded, everything = "bound" in left.column_names, np.arange(len(y))
        if bounded:  # within the bucket only what is near along another direction
            other = axes[(best + 1) % len(axes)]
            p, q = x @ other, y @ other
            by, reach = np.argsort(q, kind="stable"), _wide(left.column("bound").to_numpy(), x @ other)
            lo, hi = np.searchsorted(q[by], p - reach, "left"), np.searchsorted(q[by], p + reach, "right")
        for i in range(len(x)):
            at = np.sort(by[lo[i]:hi[i]]) if bounded else everything
            d = np.sqrt(((y[at] - x[i]) ** 2).sum(1))
            some = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]) if len(d) else np.zeros(0, int)
            some = some[np.argsort(d[some], kind="stable")][:k]
            rows.append(np.full(len(some), i))
            which.append(at[some])
            far.append(d[some])
        rows, which, far = (np.concatenate(v) if v else np.zeros(0, int) for v in (rows, which, far))
        own, found = left.take(pa.array(rows.astype(np.int64))), right.take(pa.array(which.astype(np.int64)))
        out = pa.table({"id": own.column("id"), "distance": pa.array(far.astype(float)), **{c: found.column(c) for c in order}, "_y": found.column("_y"), "gap": own.column("gap")})
        return pa.Table.from_batches(out.to_batches(max_chunksize=ROWS), out.schema)

    def met(asked: DataFrame, dealt: DataFrame) -> DataFrame:
        found = asked.groupBy("axis", "bucket").cogroup(dealt.groupBy("axis", "bucket")).applyInArrow(closest, result)
        return found.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", *order, F.col("_y").alias("y")))), 1, k).alias("near"), F.max("gap").alias("gap"))

    best = 0
    near = met(_dealt(asking.select("id", *zs), zs, axes, cuts, 1, ["id", *zs]), dealt)
    last = F.element_at("near", -1)["distance"]
    near = near.select("id", "near", ((F.size("near") == k) & (last <= F.col("gap")) | (F.col("gap") == float("inf"))).alias("proven"),
                       F.when(F.size("near") == k, last).otherwise(float("inf")).alias("bound"))
    near = materialise(near, "near")
    if rounds == 0 or near.where("not proven").isEmpty():
        return near.drop("bound")
    left = materialise(_reaching(asking.select("id", *zs).join(near.where("not proven").select("id", "bound"), "id"), zs, axes, cuts), "left")
    best = left.groupBy("axis").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).orderBy("n", "axis").first()["axis"]
    asked = left.where(F.col("axis") == best).select("id", *zs, "bound", "axis", F.explode(F.sequence("lo", "hi")).alias("bucket"), F.lit(float("inf")).alias("gap"))
    wanted = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most one number for each bucket
    again = _dealt(complete, zs, axes, cuts, 0, [*zs, *order, "_y"], (best, wanted)).drop("gap")
    return near.where("proven").drop("bound").unionByName(met(asked, again).select("id", "near", F.lit(True).alias("proven")))


def impute(df: DataFrame, target: str, features: list[str], k: int = 5, order: tuple[str, ...] = ("symbol", "date"), bucket: int = BUCKET) -> DataFrame:
    """Null targets become the mean of the k nearest complete rows over all ``features`` (standardised, Euclidean).

    Rows that lack a feature themselves, and all rows where nothing is complete, get the mean of the target. Features without spread count as equal.
    """
    rows = materialise(df.withColumn("_id", F.monotonically_increasing_id()), "impute")
    stats = rows.agg(F.avg(target).alias("_mean"), *[f(F.col(c).cast("double")).alias(f"_{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    zs = [f"_z{i}" for i in range(len(features))]
    scaled = attach(rows, stats).withColumns({z: (F.col(c).cast("double") - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0) for i, (z, c) in enumerate(zip(zs, features, strict=True))})
    scaled = scaled.where(" and ".join(f"{z} is not null" for z in zs))
    complete = scaled.where(F.col(target).isNotNull()).select(*zs, *order, F.col(target).cast("double").alias("_y"))
    near = nearest(scaled.where(F.col(target).isNull()).select(F.col("_id").alias("id"), *zs), complete, zs, list(order), k, bucket)
    mean = F.aggregate("near", F.lit(0.0), lambda a, s: a + s["y"], lambda a: a / F.size("near"))
    found = near.where(F.size("near") > 0).select(F.col("id").alias("_id"), mean.alias("_found"))
    out = attach(rows.join(found, "_id", "left"), stats.select("_mean"))
    return out.select(*[F.coalesce(F.col(c), F.col("_found"), F.col("_mean")).alias(c) if c == target else F.col(c) for c in df.columns])
