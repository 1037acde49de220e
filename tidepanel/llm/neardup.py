"""Near-duplicate documents by BagMinHash over multisets of five-word shingles.

A document is the multiset of its shingles; likeness is the weighted Jaccard index, the sum of minima over the sum of
maxima of the multiplicities. Each shingle has a Poisson process over the plane of weight and time. The weight axis is cut
into 0-1, 1-2, 2-4, 4-8, ..., and a shingle of weight w runs the processes of the pieces it reaches; in the last one, only
points below w count. A point falls on one of the signature's components, which keeps the earliest. Processes are seeded by
shingle and piece alone, so two documents agree in a component with probability equal to their likeness. Points come in
order of time and stop when they are later than the slowest component, so long documents need few points per shingle.

Linking, once rows with the same multiset are one node:

1. In each band's bucket every node is compared with the head, the node of the smallest id: linear in the bucket.
2. A node x that this leaves outside the head's component may still match another node y of the bucket. Both are compared
   with the component's root, also linear. One minus the likeness is a metric, so the distances of x and y to the root differ
   by no more than a link allows. Beyond that, a link needs t / (1 + t) (|x| + |y|) common items at likeness t. Either
   x and y each share that many with the root; such pairs are found by size, as both must be nearly contained in a larger
   root. Or they share an item that the root lacks, and the first such item (rare ones first) stands among the first
   (1 - t) n + 1 ones of both, so pairs are found by these items. Copies with edits of their own share none, and
   documents that share only the passage that made the bucket none either. The nodes with such an item are first compared
   with the smallest of them, and only what is then still in different components is compared in pairs.

Every link is verified on the whole multisets. Classes are the connected components.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import STEP_BYTES, Stage, flat, giving_back, id_text, mixed, range_hash, steps, words

SHINGLE = 5
#: At a likeness of 0.8 a pair misses every band with probability (1 - 0.8**ROWS)**BANDS = 3e-6.
BANDS, ROWS = 24, 4
ALIKE = 0.8
_STEP, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def shingles(batch: pa.RecordBatch, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every shingle; a text of fewer words is one shingle, one without words has none."""
    data, at = flat(batch.column("text"))
    h, _, _, first = words(data, at)
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    text = np.repeat(np.arange(batch.num_rows), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    return range_hash(h, start, np.minimum(start + size, first[1:][text])), text


def weighted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their multiplicity, ordered by text."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return h[at], t[at], np.diff(np.append(at, len(h)))


def signatures(h: np.ndarray, text: np.ndarray, weight: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """BagMinHash of each text: uint64 per component, the time in the upper half and the point's name in the lower."""
    best = np.full((n_texts, size), np.uint64(0x7F800000_FFFFFFFF))
    slowest = np.full(n_texts, np.inf, np.float32)
    seeds, owner, low, width, most = [], [], [], [], []
    lo, hi = 0, 1
    while True:  # the pieces of the weight axis
        reach = weight > lo
        if not reach.any():
            break
        seeds.append(mixed(h[reach] + np.uint64(hi * 0xA0761D6478BD642F & _ALL)))
        owner.append(text[reach])
        most.append(weight[reach])
        low.append(np.full(reach.sum(), lo, np.int64))
        width.append(np.full(reach.sum(), hi - lo, np.int64))
        lo, hi = hi, hi * 2
    if not seeds:
        return best
    seed, own, low, width, most = (np.concatenate(x) for x in (seeds, owner, low, width, most))
    time = np.zeros(len(seed))
    k = 0
    while len(seed):
        k += 1
        draw = mixed(seed + np.uint64(k * _STEP & _ALL))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / width
        stamp = time.astype(np.float32)
        live = stamp <= slowest[own]
        if not live.all():
            seed, own, low, width, most, time, draw, stamp = (x[live] for x in (seed, own, low, width, most, time, draw, stamp))
        where = mixed(draw ^ np.uint64(0xE7037ED1A0B428DB))
        point = low + ((where >> np.uint64(32)) % width.astype(np.uint64)).astype(np.int64)
        real = point < most
        component = ((where & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
        value = (stamp.view(np.uint32).astype(np.uint64) << np.uint64(32)) | (draw & np.uint64(0xFFFFFFFF))
        np.minimum.at(best.reshape(-1), (own * size + component)[real], value[real])
        slowest = (best.max(axis=1) >> np.uint64(32)).astype(np.uint32).view(np.float32)
    return best


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, f1, f2, n, bands): two sums that name the multiset, its size, and a key of (band, components) per band; null without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in giving_back(steps(batches, limit=STEP_BYTES // 2)):
            hashes, text = shingles(part, size)
            m = part.num_rows
            h, t, weight = weighted(hashes, text)
            sums = []
            for salt in (1, 2):
                total = np.zeros(m, np.uint64)
                np.add.at(total, text, mixed(hashes ^ np.uint64(salt * 0x5851F42D4C957F2D & _ALL)))
                sums.append(total.view(np.int64))
            n = np.bincount(text, minlength=m)
            signature = signatures(h, t, weight, m, bands * rows)
            names = (signature & np.uint64(0xFFFFFFFF)).reshape(m * bands, rows)
            key = range_hash(names.reshape(-1), np.arange(0, m * bands * rows, rows), np.arange(0, m * bands * rows, rows) + rows)
            key = mixed(key + np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_STEP), m))
            none = n == 0
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, m * bands + 1, bands), pa.int32()), pa.array(key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, mask=none) for x in sums), pa.array(n, pa.int64()), keys], ["doc_id", "f1", "f2", "n", "bands"])
    return docs.mapInArrow(run, "doc_id long, f1 long, f2 long, n long, bands array<long>")


def multisets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, items binary): sorted 32-bit hashes of (shingle, how many times it came before), so a multiset is a set."""
    def run(batches):
        for part in giving_back(steps(batches)):
            h, t, weight = weighted(*shingles(part, size))
            again = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            item = (mixed(np.repeat(h, weight) + again.astype(np.uint64) * np.uint64(_STEP)) >> np.uint64(32)).astype(np.uint32)
            t = np.repeat(t, weight)
            item = item[np.lexsort((item, t))]
            cut = np.searchsorted(t, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([item[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["doc_id", "items"])
    return docs.mapInArrow(run, "doc_id long, items binary")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays, equal items counted as often as in both."""
    if len(x) > len(y):
        x, y = y, x
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    same = both[1:] == both[:-1]
    if len(x) and (x[1:] == x[:-1]).any() or (y[1:] == y[:-1]).any():  # two items of one text with the same 32 bits
        u, n = np.unique(x, return_counts=True)
        v, k = np.unique(y, return_counts=True)
        _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        return int(np.minimum(n[i], k[j]).sum())
    return int(np.count_nonzero(same))


def frequent(items: DataFrame, docs: int = 20_000, most: int = 65_536) -> np.ndarray:
    """Items found often in a sample of about ``docs`` multisets, rarest first. Their place decides in which order items are looked at, no result."""
    def run(batches):
        for b in batches:
            got, n = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in b.column("items")] or [np.zeros(0, np.uint32)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.int64)), pa.array(n, pa.int64())], ["item", "n"])

    one_in = max(1, items.count() // docs)
    sample = items.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("items")
    counted = sample.mapInArrow(run, "item long, n long").groupBy("item").agg(F.sum("n").alias("n")).where("n > 2").coalesce(8)  # each of the eight sends the driver ``most`` rows at most
    return np.array([r["item"] for r in counted.orderBy(F.desc("n"), "item").limit(most).collect()][::-1], np.uint32)


def verify(pairs: DataFrame, items: DataFrame, alike: float = ALIKE, often: np.ndarray | None = None) -> DataFrame:
    """(a, b, common, total, n, rest) of each pair: sums of minima and of maxima over the whole multisets, the size
    of b's, and the first of b's items that a lacks, those in ``often`` last, as many as a prefix filter needs."""
    often = np.zeros(0, np.uint32) if often is None else often
    order = np.argsort(often)
    known = often[order]
    def run(batches):
        for b in batches:
            x, y = b.column("xs"), b.column("ys")
            common, total, size, rest = [], [], [], []
            for i in range(b.num_rows):
                p, q = np.frombuffer(x[i].as_py(), np.uint32), np.frombuffer(y[i].as_py(), np.uint32)
                c = _common(p, q)
                common.append(c)
                total.append(len(p) + len(q) - c)
                size.append(len(q))
                own = q[p[np.minimum(np.searchsorted(p, q), max(0, len(p) - 1))] != q] if len(p) else q
                if len(known) and len(own):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[np.argsort(np.where(known[at] == own, order[at] + 1, 0), kind="stable")]
                rest.append(own[:len(q) - math.ceil(alike * len(q) - 1e-9) + 1].astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), *(pa.array(x, pa.int64()) for x in (common, total, size)), pa.array(rest, pa.list_(pa.int64()))], ["a", "b", "common", "total", "n", "rest"])
    with_b = pairs.join(items.select(F.col("doc_id").alias("b"), F.col("items").alias("ys")), "b")
    return with_b.join(items.select(F.col("doc_id").alias("a"), F.col("items").alias("xs")), "a").select("a", "b", "xs", "ys").mapInArrow(run, "a long, b long, common long, total long, n long, rest array<long>")


def components(edges: DataFrame) -> Stage:
    """(node, label): the smallest node of each node's connected component, for all nodes of ``edges`` (a, b).

    In each round every node takes the smallest of its neighbourhood, pointers are followed once more, and the edges are
    contracted to what still joins different ones; so each round is a fraction of the one before.
    """
    live = Stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = Stage(live.df.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")), "labels")
    while live.df.limit(1).count():
        hook = live.df.groupBy("b").agg(F.min("a").alias("to"))  # a < b, so pointers only go down
        far = hook.select(F.col("b").alias("to"), F.col("to").alias("further"))
        hook = Stage(hook.join(far, "to", "left").select(F.col("b").alias("node"), F.coalesce("further", "to").alias("to")), "hook")
        step = lambda df, name: df.join(hook.df.select(F.col("node").alias(name), "to"), name, "left").withColumn(name, F.coalesce("to", name)).drop("to")
        fewer = step(step(live.df, "a"), "b")
        fewer = Stage(fewer.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        moved = Stage(step(labels.df, "label").select("node", "label"), "labels")
        for old in (live, labels, hook):
            old.drop()
        live, labels = fewer, moved
    live.drop()
    return labels


def _relabel(labels: DataFrame, edges: DataFrame) -> Stage:
    """Labels (node, label) after further ``edges``: only their components are joined, not all nodes looked at again."""
    own = labels.select("node", F.col("label").alias("own"))
    for end in ("a", "b"):
        edges = edges.join(own.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("own", end)).drop("own").distinct()
    joined = components(edges)
    every = labels.select("node", "label").union(joined.df.join(labels.select("node"), "node", "left_anti"))
    every = every.join(joined.df.select(F.col("node").alias("label"), F.col("label").alias("final")), "label", "left")
    out = Stage(every.select("node", F.coalesce("final", "label").alias("label")), "labels")
    joined.drop()
    return out


def classes(docs: DataFrame, alike: float = ALIKE, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id, n_links) for every row: the smallest doc_id of its class of linked documents.

    Documents link when the weighted Jaccard index of their shingle multisets is ``alike`` or more; n_links counts the
    verified links of the row's distinct multiset and is 0 for the copies, which need none. Texts without words (null,
    empty, white space) and rows without doc_id are classes of their own. Rows that share a doc_id are one node.
    """
    docs = id_text(docs)
    sketch = Stage(sketches(docs.where("doc_id is not null"), bands, rows, size), "sketch")
    nodes = Stage(sketch.df.where("f1 is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.max("n").alias("n"), F.min_by("bands", "doc_id").alias("bands")), "nodes")
    spread = nodes.df.select("node", F.explode("bands").alias("key"))
    heads = Stage(spread.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").select("key", "head"), "heads")
    members = Stage(spread.join(heads.df, "key").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "members")
    # stored, so that its true size decides whether the texts have to be shuffled for it
    wanted = Stage(members.df.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    items = Stage(multisets(docs.join(wanted.df, "doc_id", "left_semi"), size), "items")
    often = frequent(items.df)
    checked = Stage(verify(members.df, items.df, alike, often), "checked")
    linked = (F.col("common") >= F.lit(alike) * F.col("total")) & (F.col("total") > 0)
    label = components(checked.df.where(linked))

    # what the heads did not settle: all nodes of such a component's buckets against its root
    met = (checked.df.select(F.col("a").alias("head"), F.col("b").alias("node"))
           .join(label.df.select("node", F.col("label").alias("own")), "node", "left")
           .join(label.df.select(F.col("node").alias("head"), F.col("label").alias("top")), "head", "left")
           .select("node", F.coalesce("own", "node").alias("own"), F.coalesce("top", "head").alias("top")).distinct())
    met = Stage(met.withColumn("outside", F.col("own") != F.col("top")), "met")
    open_ = met.df.where("outside").select("top").distinct()
    pairs = met.df.where("node <> top").join(open_, "top", "left_semi").select(F.col("top").alias("a"), F.col("node").alias("b"))
    done = pairs.join(checked.df, ["a", "b"]).select(*checked.df.columns)
    rooted = Stage(done.union(verify(pairs.join(checked.df.select("a", "b"), ["a", "b"], "left_anti"), items.df, alike, often)), "rooted")
    named = rooted.df.select(F.col("a").alias("top"), F.col("b").alias("node"), (1 - F.col("common") / F.col("total")).alias("far"), "common", "n", "rest").join(met.df, ["top", "node"])
    slack, need = 1 - alike + 1e-9, alike / (1 + alike)
    least = named.where("outside").groupBy("top").agg(F.min("far").alias("nearest"))
    named = Stage(named.join(least, "top").where(F.col("outside") | (F.col("far") >= F.col("nearest") - slack)), "named")
    side = lambda df, k, *keys: df.select("top", *keys, *[F.col(c).alias(f"{k}_{c}") for c in ("node", "far", "n", "common", "own", "outside")])
    fit = ((F.col("x_own") != F.col("y_own")) & (F.abs(F.col("x_far") - F.col("y_far")) <= slack) & (~F.col("y_outside") | (F.col("x_node") < F.col("y_node")))
           & (F.col("x_n") >= F.lit(alike) * F.col("y_n")) & (F.col("y_n") >= F.lit(alike) * F.col("x_n")))
    rest = Stage(named.df.select("*", F.explode("rest").alias("item")).drop("rest"), "rest")
    shared = rest.df.groupBy("top", "item").agg(F.count(F.lit(1)).alias("many"), F.max("outside").alias("any")).where("many > 1 and any").select("top", "item")
    hits = rest.df.join(shared, ["top", "item"], "left_semi")
    # once more a star: the smallest open node of each item against the others that have it, so that families join up first
    hits = Stage(hits, "hits")
    star = hits.df.where("outside").groupBy("top", "item").agg(F.min(F.struct("node", "own", "n")).alias("h"))
    sized = F.least("n", "h.n") >= F.lit(alike) * F.greatest("n", "h.n")  # or no link is possible
    star = hits.df.join(star, ["top", "item"]).where((F.col("own") != F.col("h.own")) & sized).select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct()
    starred = Stage(verify(star, items.df, alike), "starred")
    known = _relabel(label.df, checked.df.where(linked).select("a", "b").union(rooted.df.where(linked).select("a", "b")).union(starred.df.where(linked).select("a", "b")))
    fresh = lambda df: df.drop("own").join(known.df.select("node", F.col("label").alias("own")), "node", "left").withColumn("own", F.coalesce("own", "node"))
    # a pair is made at the first item that its nodes share, not at each
    theirs = hits.df.groupBy("top", "node").agg(F.collect_list("item").alias("theirs"))
    hits_now, named_now = fresh(hits.df.join(theirs, ["top", "node"])), fresh(named.df.drop("rest"))
    once = F.array_min(F.array_intersect("x_theirs", "y_theirs")) == F.col("item")
    by_item = (side(hits_now.where("outside"), "x", "item", F.col("theirs").alias("x_theirs"))
               .join(side(hits_now, "y", "item", F.col("theirs").alias("y_theirs")), ["top", "item"]).where(fit & once))
    # both nearly contained in the root: x takes sizes from alike * n up to what its common items allow, in steps of 2 %
    step = lambda n: F.floor(F.log(n) / math.log(1.02)).cast("int")
    room = F.col("common") / need - F.col("n")
    inside = named_now.where(room >= F.lit(alike) * F.col("n") - 1e-6)
    sizes = F.explode(F.sequence(step(F.lit(alike) * F.col("n")), step(F.greatest(room, F.lit(1.0)))))
    by_size = side(inside.where("outside").withColumn("size", sizes), "x", "size").join(side(inside.withColumn("size", step(F.col("n"))), "y", "size"), ["top", "size"])
    enough = F.least("x_common", "y_common") >= F.lit(need) * (F.col("x_n") + F.col("y_n")) - 1e-6
    near = by_item.select(F.col("x_node").alias("x"), F.col("y_node").alias("y")).union(by_size.where(fit & enough).select("x_node", "y_node"))
    second = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    again = Stage(verify(second, items.df, alike), "again")
    found = [x.df.where(linked).select("a", "b") for x in (checked, rooted, starred, again)]
    links = found[0].union(found[1]).union(found[2]).union(found[3]).distinct()
    full = _relabel(known.df, found[3])

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    placing = nodes.df.select("f1", "f2", "node").join(full.df.select("node", "label"), "node", "left").join(degree, "node", "left")
    placing = Stage(placing.select("f1", "f2", "node", F.coalesce("label", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "known")
    placed = (sketch.df.select("doc_id", "f1", "f2").join(placing.df, ["f1", "f2"], "left")
              .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.when(F.col("doc_id") == F.col("node"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links")))
    for used in (nodes, heads, members, wanted, items, checked, label, met, rooted, named, rest, hits, starred, known, again, full):
        used.drop()
    return placed.union(docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """All columns of one row per class, that of the smallest doc_id; rows without doc_id or words stay.

    Rows that share a doc_id are looked at one by one, in order of their text's hash: only those that repeat another text go.
    """
    named = docs.where("doc_id is not null")
    if not named.groupBy("doc_id").count().where("count > 1").limit(1).count():
        stay = classes(docs, **options).where("doc_id = class_id").select("doc_id")
        return docs.join(stay, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
    mark = "_" + "_".join(docs.columns)[:20] + "_row"
    # sorted by ranges, so numbers ascend by doc_id; stored, as they would not be the same again
    rows = Stage(named.orderBy("doc_id", F.xxhash64("text")).withColumn(mark, F.monotonically_increasing_id()), "rows")
    found = classes(rows.df.select(F.col(mark).alias("doc_id"), "text"), **options)
    stay = found.where("doc_id = class_id").select(F.col("doc_id").alias(mark))
    return rows.df.join(stay, mark, "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
