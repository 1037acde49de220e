"""Merkle manifest of a dataset: one hash tree per source, one tree over the sources, and proofs for single rows.

A tree has three children per node. Its nodes are numbered across the cluster (range partitioning and offsets per
partition), then cut into aligned blocks of 3**DEPTH; a block keeps each of its levels as one string of hex
digests. Fixed-width substrings of 192 characters are the runs that parents are hashed from, the substrings left
and right of a node inside its run are its siblings. The blocks' top digests are the nodes of the next, smaller
tree of blocks, until every tree is one block. All of this is SQL functions; a block is the largest thing in a task.

Rows: null fields are leaves' ``-``; a null source is a source of its own, before all others. Within a source, rows
ascend by doc_id, null ids first, repeated ids by leaf; rows that are alike in all hashed fields have one leaf each. Rows
without an id are never tampered with. An empty table has no rows and no root. Columns beyond the five are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.llm.common import Stage

DEPTH = 6
BLOCK = 3 ** DEPTH
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Levels above n nodes, for n up to a block.
HEIGHT = "CASE " + " ".join(f"WHEN n <= {3 ** k} THEN {k}" for k in range(DEPTH)) + f" ELSE {DEPTH} END"
POWERS = f"array({', '.join(str(3 ** k) for k in range(DEPTH + 1))})"
#: Parents of a level: the digest of each run of three, as one string (its bytes, so that substrings start at once).
PARENTS = ("cast(array_join(transform(sequence(0, (octet_length({s}) - 1) div 192), i -> sha2(substring({s}, cast(i * 192 + 1 as int), 192), 256)), '') as binary)")
LEVELS = (f"CASE WHEN height = 0 THEN array(level) ELSE aggregate(sequence(1, height), array(level), (a, l) -> concat(a, array({PARENTS.format(s='a[l - 1]')}))) END")
#: The flanking substrings of node ``r`` of a block, from its own level up to the block's top.
_POS = f"(r div {POWERS}[l])"
_RUN = f"({_POS} div 3 * 192)"
SEGMENTS = (f"CASE WHEN height = 0 THEN cast(array() as array<struct<left: binary, right: binary>>) ELSE transform(sequence(0, height - 1), l -> struct("
            f"substring(levels[l], cast({_RUN} + 1 as int), cast({_POS} % 3 * 64 as int)) as left, "
            f"substring(levels[l], cast({_RUN} + {_POS} % 3 * 64 + 65 as int), cast((2 - {_POS} % 3) * 64 as int)) as right)) END")
PATH = f"transform(members, m -> struct(m as m, concat(transform(array(m.idx % {BLOCK}), r -> {SEGMENTS})[0], above) as path))"
PROOF = "sha2(aggregate(p.path, cast('' as binary), (a, s) -> concat(a, s.left, s.right)), 256)"
FOLD = "aggregate(p.path, {start}, (h, s) -> sha2(concat(s.left, cast(h as binary), s.right), 256))"


def field(name: str, value: Column | None = None) -> Column:
    """``-`` for null, else length in bytes, colon, value."""
    text = (F.col(name) if value is None else value).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """(key, doc_id, leaf, tampered): key orders sources, ``tampered`` is the leaf without line feeds, null where the row is left alone."""
    head = [field(c) for c in FIELDS[:-1]]
    cut = field("text", F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")))
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(F.col("text").cast("string"), F.lit("\n"))
    return docs.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.sha2(F.concat(*head, field("text")).cast("binary"), 256).alias("leaf"),
                       F.when(hit, F.sha2(F.concat(*head, cut).cast("binary"), 256)).alias("tampered"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx, the place within ``key`` by ``order`` from 0, and n, the rows of the key; no key is gathered in one task."""
    at = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("at", F.monotonically_increasing_id())
    at = Stage(at, "numbered").df.withColumn("part", F.shiftright("at", 33))
    parts = at.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    w = Window.partitionBy("key")
    parts = parts.select("key", "part", "first", F.coalesce(F.sum("c").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                         F.sum("c").over(w).alias("n"))
    return at.join(parts, ["key", "part"]).withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


@dataclass
class Tree:
    """Blocks of one stage (key, block, n, height, members, levels) and the tree over their tops, if any key has several."""
    blocks: DataFrame
    upper: Tree | None

    def roots(self) -> DataFrame:
        """(key, root)."""
        if self.upper:
            return self.upper.roots()
        return self.blocks.select("key", F.expr("cast(levels[height] as string)").alias("root"))

    def with_paths(self, above: DataFrame | None = None) -> DataFrame:
        """Blocks with ``above``, the sibling segments above each block's top; ``above`` (key, path) continues beyond the roots."""
        none = F.expr("cast(array() as array<struct<left: binary, right: binary>>)")
        if not self.upper:
            out = self.blocks.withColumn("root", F.expr("cast(levels[height] as string)"))
            if above is None:
                return out.withColumn("above", none)
            return out.drop("root").join(above.select("key", "root", F.col("path").alias("above")), "key")
        higher = self.upper.with_paths(above).select("key", "root", F.explode(F.expr(PATH)).alias("p"))
        return self.blocks.join(higher.select("key", F.expr("p.m.idx").alias("block"), "root", F.col("p.path").alias("above")), ["key", "block"])


def tree(nodes: DataFrame) -> Tree:
    """From (key, idx, n, leaf, further columns that members keep)."""
    rest = [c for c in nodes.columns if c not in ("key", "idx", "n")]
    blocks = nodes.groupBy("key", F.expr(f"idx div {BLOCK}").alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("idx", *rest))).alias("members"))
    blocks = blocks.withColumn("height", F.expr(HEIGHT)).withColumn("level", F.expr("cast(array_join(transform(members, m -> m.leaf), '') as binary)"))
    blocks = Stage(blocks.select("key", "block", "n", "height", "members", F.expr(LEVELS).alias("levels")), "merkle").df
    if (blocks.agg(F.max("n").alias("n")).first()["n"] or 0) <= BLOCK:
        return Tree(blocks, None)
    tops = blocks.select("key", F.col("block").alias("idx"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.expr("cast(levels[height] as string)").alias("leaf"))
    return Tree(blocks, tree(tops))


def trees(docs: DataFrame) -> tuple[Tree, Tree]:
    """The trees of all sources, and the tree over their roots."""
    per_source = tree(numbered(leaves(docs), ["doc_id", "leaf"]))
    tops = per_source.roots().select(F.lit("").alias("key"), F.col("key").alias("source_key"), F.col("root").alias("leaf"))
    return per_source, tree(numbered(tops, ["source_key"]))


def manifest(docs: DataFrame) -> DataFrame:
    """(source, n_rows, subroot, root): what to publish of a dataset; two datasets are the same if their roots are."""
    per_source, top = trees(docs)
    n = per_source.blocks.groupBy("key").agg(F.sum(F.size("members")).alias("n_rows"))
    above = top.with_paths().select("root", F.explode(F.expr("transform(members, m -> m.source_key)")).alias("key"))
    out = per_source.roots().withColumnRenamed("root", "subroot").join(n, "key").join(above, "key")
    return out.select(F.expr("CASE WHEN key = '' THEN NULL ELSE substring(key, 2) END").alias("source"), "n_rows", "subroot", "root")


def verify(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof of every row, and whether the row as it is now (``tampered``) still leads to the root."""
    per_source, top = trees(docs)
    beyond = top.with_paths().select("root", F.explode(F.expr(PATH)).alias("p")).select(F.expr("p.m.source_key").alias("key"), F.expr("p.m.leaf").alias("subroot"), "root", F.expr("p.path").alias("path"))
    blocks = per_source.with_paths(beyond).join(beyond.select("key", "subroot"), "key")
    done = F.expr(f"transform({PATH}, p -> struct(p.m.doc_id as doc_id, p.m.leaf as leaf, {PROOF} as proof_sha256, {FOLD.format(start='coalesce(p.m.tampered, p.m.leaf)')} as folded_root))")
    out = blocks.select("subroot", "root", F.explode(done).alias("d"))
    return out.select("d.doc_id", "d.leaf", "subroot", "root", "d.proof_sha256", "d.folded_root", (F.col("d.folded_root") == F.col("root")).alias("verified"))


def _crc(text: str) -> str:
    """CRC-32 of a short ASCII string, bit by bit."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii(substr({text}, i, 1)), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}::BIGINT[]), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"


def _fields(text: str) -> str:
    values = [f"{c}::VARCHAR" for c in FIELDS[:-1]] + [text]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + "))"


SQL = f"""WITH RECURSIVE doc AS (SELECT row_number() OVER () AS id, doc_id, source, {_fields("text")} AS leaf,
    CASE WHEN {_crc("doc_id::VARCHAR")} % 2 = 0 THEN {_fields("replace(text, chr(10), '')")} END AS tampered FROM documents),
  place AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM doc),
  low AS (SELECT source AS k, 0 AS lvl, r AS idx, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM place
    UNION ALL SELECT k, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY k, lvl, idx // 3),
  tops AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS r FROM low WHERE n = 1),
  high AS (SELECT 0 AS lvl, r AS idx, subroot AS h, count(*) OVER () AS n FROM tops
    UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY lvl, idx // 3),
  beside AS (
    SELECT id, lvl, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx < i), '') AS lo, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx > i), '') AS hi
      FROM (SELECT p.id, l.lvl, l.idx, l.h, p.r // (3 ** l.lvl)::BIGINT AS i FROM place p JOIN low l ON p.source IS NOT DISTINCT FROM l.k AND l.n > 1
        AND l.idx // 3 = p.r // (3 ** (l.lvl + 1))::BIGINT) GROUP BY id, lvl, i
    UNION ALL
    SELECT id, lvl + 1000, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx < i), ''), coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx > i), '')
      FROM (SELECT p.id, l.lvl, l.idx, l.h, t.r // (3 ** l.lvl)::BIGINT AS i FROM place p JOIN tops t ON p.source IS NOT DISTINCT FROM t.k JOIN high l ON l.n > 1
        AND l.idx // 3 = t.r // (3 ** (l.lvl + 1))::BIGINT) GROUP BY id, lvl, i),
  path AS (SELECT id, string_agg(lo || hi, '' ORDER BY lvl) AS proof, list(lo || ',' || hi ORDER BY lvl) AS steps FROM beside GROUP BY id),
  done AS (SELECT doc_id, leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(steps, [])), lambda h, s: sha256(split_part(s, ',', 1) || h || split_part(s, ',', 2))) AS folded_root
    FROM place p JOIN tops t ON p.source IS NOT DISTINCT FROM t.k LEFT JOIN path USING (id))
  SELECT *, folded_root = root AS verified FROM done"""
