"""Approximate nearest neighbours on shifted space-filling curves.

Largest inner product becomes nearest point by one more coordinate, sqrt(M^2 - |v|^2) for candidates and 0 for queries. Several
random projections to a few dimensions, each shifted at random, are ordered along Hilbert curves; each ordering is
range-partitioned into blocks. A query takes part in the blocks around its own place on every curve, blocks score their
queries in one matrix product, and the windows merge and rerank by the original vectors.

How many blocks a window spans is measured, not guessed: a bounded sample of queries is answered exhaustively, and the
narrowest window that holds enough of those answers is used. On data without structure (independent directions) a window
must be a large share of each curve; on clustered data it is a few blocks.

Equal vectors are one point with the smallest ids that any answer can need, so copies crowd nothing out.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.llm.common import Stage

CURVES, DIMS, BITS = 3, 7, 9
#: Points in a block, queries that a block scores at once.
BLOCK, CHUNK = 2048, 4096
#: Queries of the sample and the share of their true neighbours that windows must hold.
SAMPLE, RECALL = 128, 0.955


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of whole-number points (rows), by undoing the curve's turns bit by bit."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(high, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[:, n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[:, i] >> b & 1
    return key


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _keys(points: DataFrame, dim: int, longest: float, scale: float, curves: int) -> DataFrame:
    """(rep, v, keys, query_keys): the place of each point on every curve, as a candidate and as a query."""
    rng = np.random.Generator(np.random.PCG64(7))
    axes = [np.linalg.qr(rng.normal(size=(dim + 1, min(DIMS, dim + 1))))[0] for _ in range(curves)]
    shifts = [rng.random(a.shape[1]) for a in axes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), dim)
            more = np.sqrt(np.maximum(longest**2 - (v * v).sum(1), 0))
            out = []
            for extra in (more, np.zeros(len(v))):
                x = np.column_stack([v, extra])
                keys = []
                for a, s in zip(axes, shifts, strict=True):
                    cell = np.floor((x @ a / (8 * scale) + 0.5) * (1 << BITS) + s * (1 << BITS) / 16)
                    keys.append(hilbert(np.clip(cell, 0, (1 << BITS) - 1)))
                out.append(pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack(keys).reshape(-1)), curves).cast(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("v"), b.column("query"), *out], ["rep", "v", "query", "keys", "query_keys"])

    return points.select("rep", "v", "query").mapInArrow(run, "rep long, v array<double>, query boolean, keys array<long>, query_keys array<long>")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, ties to the smaller id; fewer if there are fewer."""
    k = min(k, scores.shape[1])
    if k < scores.shape[1]:
        floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        if ((scores >= floor[:, None]).sum(1) == k).all():
            part = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            return ids[part], np.take_along_axis(scores, part, 1)
        order = np.stack([np.lexsort((ids, -row))[:k] for row in scores])
        return ids[order], np.take_along_axis(scores, order, 1)
    return np.tile(ids, (len(scores), 1)), scores


def _rows(q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.Table:
    at = pa.array(np.arange(0, ids.size + 1, ids.shape[1] or 1)[:len(q) + 1], pa.int32())
    return pa.table({"q": q, "ids": pa.ListArray.from_arrays(at, pa.array(ids.reshape(-1), pa.int64())), "scores": pa.ListArray.from_arrays(at, pa.array(scores.reshape(-1), pa.float64()))})


FOUND = "q long, ids array<long>, scores array<double>"


def _merge(k: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks().flatten().to_numpy()
        scores = table.column("scores").combine_chunks().flatten().to_numpy()
        order = np.lexsort((ids, -scores))
        _, first = np.unique(ids[order], return_index=True)
        keep = order[np.sort(first)][:k]
        return _rows(table.column("q").to_numpy()[:1], ids[keep][None, :], scores[keep][None, :])
    return run


def _score(dim: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _rows(np.zeros(0, np.int64), np.zeros((0, 1), np.int64), np.zeros((0, 1)))
        ids, v = left.column("rep").to_numpy(), _matrix(left.column("v").combine_chunks(), dim)
        out, q, u = [], right.column("rep").to_numpy(), _matrix(right.column("v").combine_chunks(), dim)
        for i in range(0, len(q), 256):
            got, score = _best(ids, u[i:i + 256] @ v.T, k)
            out.append(_rows(q[i:i + 256], got, score))
        return pa.concat_tables(out)
    return run


def _exhaustive(points: DataFrame, queries: list, dim: int, k: int) -> DataFrame:
    """The k best points for a bounded list of (rep, v): every point is scored, each task keeps its best."""
    ids, u = np.array([q["rep"] for q in queries]), np.array([q["v"] for q in queries]).reshape(-1, dim)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                some = b.slice(i, 8192)
                got, score = _best(some.column("rep").to_numpy(), u @ _matrix(some.column("v"), dim).T, k)
                yield from _rows(ids, got, score).to_batches()

    return points.select("rep", "v").mapInArrow(run, FOUND).groupBy("q").applyInArrow(_merge(k), FOUND)


def search(vectors: DataFrame, every: int = 20, k: int = 20, curves: int = CURVES, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose vec_id is divisible by ``every``.

    Vectors that are null, zero, hold null or non-finite components, or are not of the commonest length take no part, nor do
    null ids. Repeated rows count once. Ties go to the smaller vec_id; fewer candidates give fewer rows, an empty table none.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(good & F.col("vec_id").isNotNull()).distinct()
    rows = Stage(rows, "vectors")
    common = rows.df.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    dim = common["dim"]
    rows_df = rows.df.where(F.size("v") == dim)
    is_query = F.col("vec_id") % every == 0
    points = Stage(rows_df.groupBy("v").agg(F.min("vec_id").alias("rep"), F.max(is_query).alias("query")), "points")
    tagged = Stage(rows_df.join(points.df.select("v", "rep"), "v").select("rep", "vec_id", is_query.alias("query")), "tagged")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    stats = points.df.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("most"), F.avg(square).alias("mean")).first()
    longest, scale = float(stats["most"]) ** 0.5, max((float(stats["mean"]) / dim) ** 0.5, 1e-300)
    placed = Stage(_keys(points.df, dim, longest, scale, curves), "keys")

    target = max(1, -(-int(stats["n"]) // BLOCK))
    blocks, ranges = [], []
    for c in range(curves):
        both = placed.df.select("rep", F.get("keys", F.lit(c)).alias("key"), F.lit(False).alias("asks"), "v")
        asks = placed.df.where("query").select("rep", F.get("query_keys", F.lit(c)).alias("key"), F.lit(True).alias("asks"), "v")
        dealt = both.union(asks).repartitionByRange(target, "key", "rep")
        stage = Stage(dealt.select("rep", "asks", "v", F.spark_partition_id().alias("block")), f"curve{c}")
        blocks.append(stage)
        ranges.append(int(stage.df.agg(F.max("block")).first()[0]) + 1)

    # the narrowest window that holds enough of the true neighbours of a sample
    sample = placed.df.where("query").orderBy(F.xxhash64("rep"), "rep").select("rep", "v").limit(SAMPLE).collect()
    truth = Stage(_exhaustive(placed.df, sample, dim, k + 1).select("q", F.explode("ids").alias("rep")).where("q <> rep"), "truth")
    near = None
    for c in range(curves):
        there = blocks[c].df
        own = there.where("asks").select(F.col("rep").alias("q"), F.col("block").alias("from"))
        gap = truth.df.join(own, "q").join(there.where("not asks").select("rep", "block"), "rep")
        gap = gap.select("q", "rep", (F.abs(F.col("block") - F.col("from")) / F.lit(ranges[c])).alias("gap"))
        near = gap if near is None else near.union(gap)
    share = near.groupBy("q", "rep").agg(F.min("gap").alias("gap")).agg(F.expr(f"percentile(gap, {recall})")).first()[0] or 0.0

    found = None
    for c in range(curves):
        wide = int(np.ceil(share * ranges[c] - 1e-9))
        there = blocks[c].df
        chunks = max(1, -(-int(stats["n"]) * (2 * wide + 1) // (every * ranges[c] * CHUNK)))
        asks = there.where("asks").select("rep", "v", F.explode(F.sequence(F.greatest(F.lit(0), F.col("block") - wide), F.least(F.lit(ranges[c] - 1), F.col("block") + wide))).alias("block"),
                                          F.pmod(F.xxhash64("rep"), F.lit(chunks)).cast("int").alias("chunk"))
        own = there.where("not asks").select("rep", "v", "block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
        got = own.groupBy("block", "chunk").cogroup(asks.groupBy("block", "chunk")).applyInArrow(_score(dim, k + 1), FOUND)
        found = got if found is None else found.union(got)
    merged = found.groupBy("q").applyInArrow(_merge(k + 1), FOUND)
    hits = merged.select("q", F.explode(F.arrays_zip("ids", "scores")).alias("h")).select("q", F.col("h.ids").alias("rep"), F.col("h.scores").alias("score"))

    # copies: no answer needs more than the k + 1 smallest ids of a point
    few = Window.partitionBy("rep").orderBy("vec_id")
    ids = tagged.df.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1).groupBy("rep").agg(F.collect_list("vec_id").alias("ids"))
    each = hits.join(ids, "rep").groupBy("q").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "ids")).alias("lists"))
    asked = tagged.df.where("query").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("q"))
    flat = F.flatten(F.transform("lists", lambda x: F.transform(x["ids"], lambda i: F.struct(x["s"].alias("s"), i.alias("i")))))
    # points differ in score or id, copies share both lists' score: one sorted list serves all queries of a point
    ranked = each.select("q", F.slice(F.array_sort(flat), 1, 2 * (k + 1)).alias("best"))
    own = F.slice(F.filter("best", lambda x: x["i"] != F.col("query_id")), 1, k)
    out = asked.join(ranked, "q").select("query_id", F.posexplode(own).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
